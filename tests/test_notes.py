"""A small collection of notes with planted defects, read and checked from end to end."""

import pytest

from lodestar.operators import aggregates as A
from lodestar.operators import graph as G
from lodestar.operators import lint as L
from lodestar.operators import profile as P
from lodestar.operators.filters import query
from lodestar.sources import notes as N
from lodestar.functions.layout import shared_folder
from lodestar.sources.index import named_files, read_index, refresh, reindex, suspects, live_manifest, versions
from lodestar.sources.registries import Settings, enums, render_taxonomy, spec_changelog, taxonomy

NOTES = {
    "WORKS/Alpha_(book).md": """---
type: card
note_kind: work
quality: verified
created: 2024-01-05
updated: "2024-1-7"
tags: [calm, odd]
aliases:
  - The First
status: airing
score: 11
images: {cover: attachments/Alpha_cover.png}
staff:
  - {person: Ann_Lee, role: director}
  - {person: Nobody, role: writer}
site: https://example.org/a
empty: null
---
# Alpha
See [[Ann_Lee]] and [[Ann_Lee|Ann]], `[[Not_A_Link]]`, [[ann_lee]].
![[Alpha_cover.png|400]]
```
[[Fenced]]
```
## Cast
| who | voice |
| --- | --- |
| [[Ann_Lee\\|Ann]] | [[Bo]] |
| [[Ann_Lee|Ann]] | one |
- ![[Bo_cover.png|60]] **[[Bo]]** — a friend
[site](https://example.org/x_(y))
""",
    "PEOPLE/Ann_Lee.md": "---\ntype: card\nnote_kind: person\ncreated: 2023-01-01\ntags: []\nworks: [{title: 'Alpha_(book)', roles: [voice-actor]}]\n---\n# Ann Lee\nShe made [[Alpha_(book)]].\nThe First is known. alphabet\n",
    "PEOPLE/Bo.md": "---\ntype: card\nnote_kind: person\ncreated: 2024-06-01\nnew_field: null\ntags: [calm]\n---\n# Bo [[Ann_Lee]]\nNothing else. The First again: [[Alpha_(book)]]\n",
    "META/Plain.md": "No front matter, no link.\n",
    "META/Bad.md": "---\na: [1\n---\ntext\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("notes")
    for path, text in NOTES.items():
        (top / path).parent.mkdir(exist_ok=True)
        (top / path).write_text(text, encoding="utf-8")
    for path in ("attachments/Alpha_cover.png", "WORKS/attachments/stray.png"):
        (top / path).parent.mkdir(exist_ok=True)
        (top / path).write_bytes(b"\x89PNG")
    return str(top)


@pytest.fixture(scope="module")
def vault(spark, root):
    return N.Vault(spark, root)


def test_parse(vault):
    rows = {x.name: x for x in vault.notes.collect()}
    assert set(rows) == {"Alpha_(book)", "Ann_Lee", "Bo", "Plain", "Bad"}
    alpha = rows["Alpha_(book)"]
    assert (alpha.path, alpha.folder, alpha.created, alpha.tags, alpha.aliases) == ("WORKS/Alpha_(book).md", "WORKS", "2024-01-05", ["calm", "odd"], ["The First"])
    assert rows["Plain"].error is None and rows["Plain"].front_lines == 0 and rows["Bad"].error


def test_links_and_embeds(vault):
    found = [(x.path.split("/")[1], x.line, x.target, x.display_text) for x in vault.links.collect()]
    assert ("Alpha_(book).md", 20, "Ann_Lee", None) in found and ("Alpha_(book).md", 20, "Ann_Lee", "Ann") in found
    assert not {"Not_A_Link", "Fenced"} & {x[2] for x in found}
    assert sorted((x.file, x.width) for x in vault.embeds.collect()) == [("Alpha_cover.png", 400), ("Bo_cover.png", 60)]
    assert [x.url for x in vault.external_links.orderBy("url").collect()] == ["https://example.org/a", "https://example.org/x_(y)"]
    gallery = N.gallery_entries(vault.lines).first()
    assert (gallery.file, gallery.width, gallery.target, gallery.description) == ("Bo_cover.png", 60, "Bo", "a friend")


def test_sections_and_tables(vault):
    sections = {x.section_path for x in vault.chunks.collect()}
    assert {"Alpha", "Alpha / Cast"} <= sections
    bad = vault.table_rows.where("n_cells != header_cells or raw_pipe").collect()
    assert len(bad) == 1 and bad[0].raw_pipe


def test_four_states_of_a_field(vault):
    notes = vault.notes
    assert {x.name for x in query(notes, has_field="empty").collect()} == {"Alpha_(book)"}
    assert notes.where(N.has_value("empty")).count() == 0 and notes.where(N.has_value("status")).count() == 1
    assert notes.where(N.field_value("images.cover") == "attachments/Alpha_cover.png").count() == 1
    assert query(notes, field_gte={"score": 10}, folder="WO", tags=["calm"], tags_any=["odd", "x"], fields=["status"], limit=3).collect()[0].status == "airing"


def test_graph(vault):
    links, notes = G.sourced(vault.links, vault.notes), vault.notes
    assert [x.target for x in G.broken(vault.links, notes).collect()] == ["ann_lee"]
    assert {x.name for x in G.orphans(notes, vault.links, exempt=["Bad"]).collect()} == {"Plain"}
    assert {(x.target, x.n) for x in G.duplicates(vault.links, ["path", "target"]).collect()} >= {("Ann_Lee", 4)}
    kinds = notes.selectExpr("name", "note_kind as kind")
    gaps = {(x.source, x.target) for x in G.asymmetric(links.join(notes.selectExpr("name as target"), "target", "left_semi"), kinds).collect()}
    assert gaps == {("Bo", "Ann_Lee")}
    staff = N.variant_edges(notes, "staff", "person", role="role")
    assert sorted((x.target, x.role, x.resolved) for x in G.resolve(staff, notes).collect()) == [("Ann_Lee", "director", True), ("Nobody", "writer", False)]
    assert G.required_links(staff, notes, links).count() == 0
    both = G.both_kinds(vault.links, vault.embeds)
    assert G.backlinks(both, "Alpha_cover.png").count() == 1 and G.backlinks(both, "Alpha_(book)").count() == 2


def test_text_mentions(vault):
    terms = G.mention_terms(vault.notes, ["title_english"])
    lines = N.prose(vault.lines).where("not is_heading")
    found = {(x.path, x.target, x.term) for x in G.text_mentions(lines, terms, vault.links).collect()}
    # a line that links the note is no plain mention of it; a longer word is none either
    assert {x for x in found if x[2] == "The First"} == {("PEOPLE/Ann_Lee.md", "Alpha_(book)", "The First")}
    assert all(x[2] != "Alpha (book)" for x in found)


def test_lint(spark, vault):
    settings = Settings(
        required_fields={"work": ["year"], "person": ["works"]}, always_present={"work": ["empty", "gone"]}, required_tags_by_kind={"person": ["human"]}, max_tags=1, max_links=2, score_fields=["score"],
        reciprocity_pairs=[("person", "person")], relation_fields={"person": ["works"]}, tooling_vocab=["known"], spoiler_headings=["Cast"], link_exempt=["META"],
    )
    registry = enums(spark, "note_kinds:\n  work:\n    status: &s [done, planned]\n  person:\n    status: *s\n")
    canon = taxonomy(spark, "tags:\n  - {name: calm, group: theme, description: quiet, adult_gated: false}\n  - {name: rare, group: theme}\n")
    changes = spec_changelog(spark, "kinds:\n  person:\n    - {requirement: new_field, introduced: 2024-01-01, kind_of: field}\n    - {requirement: shape, introduced: 2024-01-01, kind_of: format}\n")
    issues = L.lint(vault, settings, registry, canon, changes, show_all=True).cache()
    found = {(x.path.split("/")[1].split(".")[0], x.rule, x.detail) for x in issues.collect()}
    rules = {(a, b) for a, b, _ in found}
    assert {
        ("Alpha_(book)", "required-field"), ("Bo", "required-field"), ("Alpha_(book)", "always-present"), ("Alpha_(book)", "enum"), ("Alpha_(book)", "tag-canon"), ("Bo", "tag-required"),
        ("Ann_Lee", "empty-tags"), ("Alpha_(book)", "too-many-tags"), ("Alpha_(book)", "broken-link"), ("Alpha_(book)", "case-mismatch"), ("Alpha_(book)", "duplicate-link"), ("Alpha_(book)", "table-row"),
        ("Bo", "link-in-heading"), ("Ann_Lee", "voice-record"), ("Alpha_(book)", "embed-width"), ("Alpha_(book)", "score-range"), ("Alpha_(book)", "date-format"), ("Bo", "stub"), ("Bo", "asymmetric-link"),
        ("Ann_Lee", "schema-drift"), ("Ann_Lee", "tooling-vocabulary"), ("Alpha_(book)", "spoiler-callout"), ("Bad", "front-matter"), ("Bo", "missing-cover"), ("Bo", "thin-note"),
    } <= rules
    assert ("Bo", "schema-drift", "new_field") not in found and ("Alpha_(book)", "always-present", "empty") not in found and ("Alpha_(book)", "cover-ref") not in rules
    assert ("Plain", "no-outgoing-link") not in rules
    assert [(x.path, x.detail) for x in issues.where("rule = 'attachment-place'").collect()] == [("WORKS/attachments/stray.png", "stray.png")]
    assert issues.where("rule = 'tooling-vocabulary'").first().stream == L.HEURISTIC
    green = {x.path: x.structural_green for x in L.structural_green(vault.notes, issues).collect()}
    assert green["META/Plain.md"] and not green["WORKS/Alpha_(book).md"]
    closed = {x.path: x.closed for x in P.card_closed(vault.notes, L.structural_green(vault.notes, issues), vault.links).collect()}
    assert closed["META/Plain.md"] and not closed["PEOPLE/Bo.md"]
    profile = P.note_profile(vault.notes, vault.links, vault.embeds, issues, "Alpha_(book)").first()
    assert len(profile.backlinks) == 2 and len(profile.outgoing) == 7 and profile.lint
    assert P.fix_plan(G.broken(vault.links, vault.notes), vault.notes).first().proposal == "Ann_Lee"
    assert P.rename_plan(vault.links, vault.embeds, "Bo", "Bob").count() == 2
    assert "| calm | quiet |" in render_taxonomy(canon).first().markdown
    assert {(x.tag, x.status) for x in A.tag_health(vault.notes.selectExpr("explode(tags) as tag"), canon.selectExpr("name as tag")).collect()} == {("calm", "ok"), ("odd", "noncanon"), ("rare", "ghost")}


def test_index_and_refresh(spark, root, tmp_path, tmp_path_factory):
    import shutil

    own, index = str(tmp_path_factory.mktemp("copy") / "notes"), str(tmp_path / "index")
    shutil.copytree(root, own)
    assert reindex(spark, own, index)["indexed"] == 5
    assert read_index(spark, index)["links"].count() == 10
    assert reindex(spark, own, index)["changes"] == {"kept": 5}
    with open(f"{own}/META/New.md", "w") as f:
        f.write("See [[Bo]]\n")
    with open(f"{own}/META/Plain.md", "w") as f:
        f.write("Changed.\n")
    shutil.move(f"{own}/META/Bad.md", f"{own}/META/Bad.txt")
    assert reindex(spark, own, index)["changes"] == {"kept": 3, "added": 1, "changed": 1, "removed": 1}
    assert [x.whole for x in versions(spark, index)] == [True, False]
    assert {x.name for x in read_index(spark, index)["notes"].collect()} == {"Alpha_(book)", "Ann_Lee", "Bo", "Plain", "New"}
    assert read_index(spark, str(tmp_path / "none")) is None


def test_refresh_reads_what_changed(spark, root, tmp_path_factory):
    """Of many files three are opened; deltas are merged after so many; another time alone parses nothing; a name is no pattern."""
    import os
    import shutil

    own, index = tmp_path_factory.mktemp("many") / "notes", shared_folder(spark)
    shutil.copytree(root, own)
    for k in range(60):
        (own / f"META/N [{k}] {{x}}.md").write_text(f"---\nscore: {k}\n---\nSee [[Bo]]\n")
    assert reindex(spark, str(own), index)["indexed"] == 65
    for k in (3, 4):
        (own / f"META/N [{k}] {{x}}.md").write_text(f"---\nscore: {k}\n---\nSee [[Bo]] and [[Ann_Lee]]\n")
    os.utime(own / "META/N [5] {x}.md", (10**9, 10**9))
    files = N.listing(spark, str(own))
    odd = suspects(live_manifest(spark, index, versions(spark, index)), files)
    opened = named_files(spark, str(own), files)(odd.where("there").select("path"))
    assert len(opened.inputFiles()) == 3
    assert reindex(spark, str(own), index)["changes"] == {"changed": 2, "touched": 1, "kept": 62}
    assert reindex(spark, str(own), index)["changes"] == {"kept": 65}
    delta = versions(spark, index)[-1]
    assert spark.read.parquet(f"{index}/v{delta.seq}/notes").count() == 2
    assert read_index(spark, index)["links"].where("path like 'META/N%' and target = 'Ann_Lee'").count() == 2
    (own / "META/N [9] {x}.md").unlink()
    assert refresh(spark, index, N.listing(spark, str(own)), named_files(spark, str(own), N.listing(spark, str(own))), most_deltas=1) == {"removed": 1, "kept": 64}
    assert [x.whole for x in versions(spark, index)] == [True] and read_index(spark, index)["notes"].count() == 64
    assert reindex(spark, str(own), index, full=True)["indexed"] == 64 and reindex(spark, str(own), index)["changes"] == {"kept": 64}
