"""Stems against vectors of the algorithms' public descriptions."""

from lodestar.functions.stems import stem

ENGLISH = """consign consigned consigning consignment > consign; consist consisted consistency consistent consistently consisting consists > consist; consolation consolations console consoled consoles > consol;
consolatory > consolatori; consolidate consolidated consolidating > consolid; consonant > conson; consternation > constern; constituent > constitu; constitute constitution > constitut; knackeries > knackeri; knavish > knavish; kneaded kneading > knead;
knee knees > knee; kneel kneeling kneels > kneel; knife > knife; knightly knights > knight; knitted knitting > knit; knives > knive; knocked knocking knocks > knock; knocker knockers > knocker; generate generates generated generating > generat;
general generally > general; generic generically > generic; happy happiness > happi; sky skies > sky; dying > die; news > news; hopping > hop; hoping hope > hope; flies > fli; ties > tie; national > nation; relational > relat; by say > by say;
cry > cri; agreed > agre; feed > feed; universal universe > univers; communication > communic; proceed > proceed; controlling > control; rolls > roll""".replace(" by say > by say;", " by > by; say > say;")
RUSSIAN = """вавиловка > вавиловк; вагнера > вагнер; вагон вагона вагоне вагонов вагоном вагоны > вагон; важная важнее важнейшие важнейшими важно важного важное важной важном важному важную важны важные важный важным важных > важн;
важничал > важнича; важности важностию важность важностью > важност; вазах вазы > ваз; вакса > вакс; валандался > валанда; валентина > валентин; валериановых > валерианов; валерию > валер; валетами > валет; павел > павел;
павильон павильонам > павильон; павла > павл; павлиний павлиньи павлиньим > павлин; павлович > павлович; паволоках > паволок; пагубная > пагубн; падает падай падал падала падать падаю падают падающего падающие > пада; падаль > падал;
падение падением паденье паденья > паден; падут > падут; падучая > падуч; падшая > падш; пазухи > пазух; пакостей пакость > пакост; пакостный > пакостн; палат > палат; ёлка > елк"""


def vectors(text):
    return {w: want.strip() for words, want in (x.split(">") for x in text.replace("\n", " ").split(";")) for w in words.split()}


def test_english():
    assert {w: stem(w) for w in vectors(ENGLISH)} == vectors(ENGLISH)


def test_russian():
    assert {w: stem(w) for w in vectors(RUSSIAN)} == vectors(RUSSIAN)


def test_other_words_stay():
    assert [stem(x) for x in ("", "x", "été", "12", "a1", "日本")] == ["", "x", "été", "12", "a1", "日本"]
