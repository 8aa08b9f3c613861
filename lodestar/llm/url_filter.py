"""URL filters: rules of host and path, and beyond them logistic regression on hashed character n-grams of both.

All of it is DataFrame code: the n-grams are array expressions, hashing and regression are Spark's own transformers, trained
from a small labelled table. Judging a table of any size is one narrow pass; what the model holds is BUCKETS weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NGRAMS, BUCKETS, REGULARISATION, THRESHOLD = (3, 4, 5), 1 << 14, 0.02, 0.5
#: A list of rules becomes one expression, so it has so many entries at most.
MOST_RULES = 1000

#: URLs that are trained from where no other table is given.
LABELLED = """
allow https://www.citylibrary.org/en/catalogue/1207
allow https://blog.gardenersworld.net/2021/05/pruning-roses
allow https://docs.python-guide.org/en/latest/starting
allow http://www.riverside-museum.org/exhibitions/autumn
allow https://m.dailyherald.com/en/world/48213
allow https://news.northernpost.com/fr/politique/9921.html
allow https://www.universityofhills.edu/departments/physics
allow http://blog.stonebridge.net/de/reisen/331
allow https://recipes.kitchentable.com/soups/lentil?page=2
allow https://en.openencyclopedia.org/wiki/Photosynthesis
allow https://www.healthservice.gov/conditions/asthma
allow http://forum.linuxusers.org/t/network-setup/5512
allow https://www.weatherstation.net/forecast/today
allow https://m.sportsreview.com/en/football/7781
allow https://www.railwaytimes.com/es/noticias/228.html
allow http://archive.historysociety.org/letters/1843
allow https://blog.smallthings.com/en/314#top
allow https://theatre.oldtown.org/en/season/2020
allow https://www.childrensbooks.com/en/authors/12
allow https://developer.mapservice.net/reference/api
allow http://www.greenvalleyschool.org/teachers
allow https://journal.marinebiology.org/volumes/12/3
allow https://www.thenorthwind.com/en/1043
allow https://m.thehinterland.net/fr/2207/
allow http://blog.themarket.org/en/871.html
allow https://thestation.com/de/5512?page=2
allow https://www.traditions.net/en/40/
allow http://m.nations.org/es/718#top
allow https://foundation.com/en/9133
allow https://blog.thistle.net/en/662?utm_source=feed
allow http://www.stationers.com/en/3021.html
allow https://m.thatcham.org/fr/118
allow https://information.net/en/2290?page=2&ref=x
allow http://blog.motionpictures.com/de/604/
allow https://www.threshing.org/en/77
allow https://thespian.com/en/8123#top
allow https://photography.lakeside.com/gallery/birds
allow https://www.cyclingclub.net/routes/coast
allow http://radio.publicvoice.org/programmes/morning
allow https://www.parliament.gov/debates/2019/march
allow https://blog.woodworking.com/en/benches/18
allow https://science.academy.edu/lectures/algebra
allow http://www.townhall.gov/en/services/parking
allow https://help.mailclient.com/en/articles/210
allow https://www.astronomers.net/en/planets/saturn
allow https://m.economist-daily.com/en/markets/91
allow https://translators.wordforum.org/de/glossary
allow https://www.furniture-makers.com/en/history
allow http://chess.problemsociety.org/en/studies/64
allow https://blog.birdwatch.net/es/aves/130
allow https://www.villagechoir.org/concerts
allow https://music.conservatory.edu/fr/cours
allow https://shop.bookbinders.com/en/paper/a4
allow https://www.farmersjournal.com/en/wheat/552
allow https://blog.mountaineers.org/en/huts/19
allow http://www.courtreports.gov/cases/2011/88
allow https://www.poetryreview.net/en/poems/401
allow https://m.cinemanotes.com/de/filme/733
allow https://www.veterinary.edu/clinic/hours
allow https://opensource.projects.net/compiler/issues/9
allow https://www.hospitaltrust.org/en/visitors
allow https://travel.islandferries.com/timetable
allow http://blog.teacherroom.net/en/lessons/56
allow https://www.geologists.org/en/maps/14
block http://ads.banner-network.com/click/8812
block https://adserver.popclick.net/en/120?ref=x
block http://www.track-pixel.com/pixel/331
block https://tracker.adclicks.net/redirect?page=2
block http://m.ad-track.biz/en/55
block https://blog.trackmedia-ads.com/de/901.html
block http://www.best-casino-online.com/en/bonus
block https://casino.luckyslots.net/fr/jackpot/77
block http://m.win-casino.biz/en/381
block https://www.casinowinner.com/es/slots
block https://blog.poker-bets.net/en/12.html
block http://blog.jackpot-win.com/en/4410
block https://www.betting-bonus.net/de/wetten
block http://blog.cheap-viagra-pills.com/en/order/12
block https://www.pills-discount.net/en/22.html
block http://m.cheappills.biz/en/buy/180
block https://pharmacy-cheap-meds.com/fr/pilules
block http://www.buy-cialis-cheap.net/order
block https://blog.cheap-meds-pills.com/en/919
block http://weightloss-pills.net/en/miracle
block http://www.adult-videos.com/en/77
block https://m.adultxxx.net/en/1204
block http://blog.xxx-adult-cams.com/en/12?page=2
block https://www.sexchat-x.net/en/rooms
block http://blog.porn-tube.com/de/331
block https://adult-dating.biz/es/440
block http://m.x-adult.net/fr/902
block http://free-porn-x.com/en/18#top
block https://www.hot-xxx-girls.net/en/5
block http://www.replica-watches-cheap.com/en/rolex
block https://cheap-handbags.biz/en/outlet/71
block http://free-ringtones-download.biz/en/9
block https://www.warez-crack.net/keygen/serial
block http://download-cracks.com/en/torrent/88
block https://m.free-movies-torrent.biz/en/12
block http://www.payday-loan-fast.com/apply
block https://blog.quick-loans-cash.net/en/3#top
block http://earn-money-fast.biz/en/home/4
block https://www.make-cash-online.com/en/get-rich
block http://binary-options-win.net/en/signals
block https://crypto-giveaway.biz/en/claim/44
block http://www.free-iphone-winner.com/prize
block https://you-won-prize.net/claim?ref=x
block http://account-verify-login.com/secure/update
block https://www.secure-login-bank.net/verify/id
block http://paypa1-account.biz/en/signin
block https://spam-links.net/en/directory/1
block http://blog.linkfarm-spam.com/fr/5?utm_source=feed
block https://buy-followers.net/en/likes/100
block http://m.clickbait-ads.com/en/shock/81
block https://pop-ads.network-click.com/popup
block http://spyware-scan.biz/en/download.exe
""".strip()


#: First labels and paths that say nothing. Every labelled host is also seen with each, so that they weigh nothing.
COMMON_LABELS, COMMON_PATHS = ["", "www.", "m.", "blog."], ["", "/", "/index.html", "/en/12", "/fr/345/", "/de/6789.html", "/es/10235"]


@dataclass(frozen=True)
class Rule:
    """Fits URLs of host and of its subdomains whose path starts with path."""

    verdict: str
    host: str
    path: str = ""


def host_of(url: Column) -> Column:
    """After the first :// up to the next /, ?, # or the end; A to Z lower-cased. Empty without ://, or for null."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule (host and path) and verdict; null without one. Of equally long ones that
    with the longer host, then the first in order."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for x in sorted(rules, key=lambda x: (len(x.host + x.path), len(x.host), x.host + x.path)):
        fits = ((host == x.host) | host.endswith(f".{x.host}")) & path.startswith(x.path)
        found = F.when(fits, F.struct(F.lit(x.host + x.path).alias("rule"), F.lit(x.verdict).alias("verdict"))).otherwise(found)
    return found


def characters(text: Column) -> Column:
    """The characters of a text between ^ and $. All digits count as 0."""
    return F.split(F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$")), "")


def grams(chars: Column, mark: str, sizes: tuple[int, ...] = NGRAMS) -> Column:
    """Character n-grams, behind a mark that tells hosts' from paths'. chars: a column of its own, as each n-gram looks it up."""
    of = lambda n: F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), "")))).otherwise(F.array().cast("array<string>"))
    return F.concat(*map(of, sizes))


def with_grams(urls: DataFrame, host: str, path: str, name: str) -> DataFrame:
    split = urls.withColumns({"__host_chars": characters(F.col(host)), "__path_chars": characters(F.col(path))})
    return split.withColumn(name, F.concat(grams(F.col("__host_chars"), "h"), grams(F.col("__path_chars"), "p"))).drop("__host_chars", "__path_chars")


def labelled_urls(spark: SparkSession, text: str = LABELLED) -> DataFrame:
    """url, label (1: block) of lines that hold a verdict and a URL."""
    line = F.split("line", " ", 2)
    rows = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("line"))
    return rows.select(line[1].alias("url"), (line[0] == "block").cast("double").alias("label"))


def train(labelled: DataFrame, buckets: int = BUCKETS, regularisation: float = REGULARISATION) -> PipelineModel:
    """labelled: url, label (1: block). The model weighs which hashed n-grams a URL has: of each labelled URL, and of its host
    under each of COMMON_LABELS before each of COMMON_PATHS."""
    own = labelled.select(host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"), "label")
    bare = F.regexp_replace("__host", rf"^({'|'.join(x.replace('.', '[.]') for x in COMMON_LABELS if x)})", "")
    hosts, paths = (F.explode(F.lit(x)) for x in (COMMON_LABELS, COMMON_PATHS))
    seen = own.select(bare.alias("bare"), "label", hosts.alias("before")).select("*", paths.alias("__path"))
    rows = own.unionByName(seen.select(F.concat("before", "bare").alias("__host"), "__path", "label"))
    steps = [
        HashingTF(inputCol="__grams", outputCol="__found", numFeatures=buckets, binary=True),
        LogisticRegression(featuresCol="__found", labelCol="label", regParam=regularisation, standardization=False, maxIter=100, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction"),
    ]
    return Pipeline(stages=steps).fit(with_grams(rows, "__host", "__path", "__grams").coalesce(1))


def url_filter(pages: DataFrame, rules: list[Rule], model: PipelineModel, key: str = "page_id", url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of pages: key, host, path, rule (host and path of the longest that fits, else null), verdict (the
    rule's, else block where block_score reaches the threshold), block_score (the model's, for every row).

    A null URL, and one without ://, has an empty host and path, which no rule with a host fits, and the score of the model's
    bias. Very long URLs are judged whole. Repeated rows give repeated rows, an empty table an empty result; other columns are
    ignored.
    """
    rows = pages.select(F.col(key).alias("__key"), host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    scored = model.transform(with_grams(rows, "__host", "__path", "__grams"))
    score = vector_to_array("__probability")[1]
    found = scored.select("__key", "__host", "__path", matched_rule(F.col("__host"), F.col("__path"), rules).alias("__rule"), score.alias("__score"))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__score") >= threshold, "block").otherwise("allow"))
    return found.select(F.col("__key").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), F.col("__score").alias("block_score"))
