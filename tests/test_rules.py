import io
import os
import zipfile

import pytest
from loomspark.operators import rules
from loomspark.sources import documents, workbooks
from pyspark.sql import functions as F

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_workbook(path, sheets):
    """Text cells, every second one shared, the others inline; empty cells are left out."""
    shared, bodies = [], []
    for rows in sheets.values():
        body = ""
        for r, row in enumerate(rows, 1):
            body += f'<row r="{r}">'
            for c, value in enumerate(row):
                place = f"{chr(65 + c)}{r}"
                if value and c % 2:
                    body += f'<c r="{place}" t="s"><v>{len(shared)}</v></c>'
                    shared.append(value)
                elif value:
                    body += f'<c r="{place}" t="inlineStr"><is><t>{value}</t></is></c>'
            body += "</row>"
        bodies.append(f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {NS} {REL}><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        for k, body in enumerate(bodies):
            z.writestr(f"xl/worksheets/s{k}.xml", body)


SHEETS = {
    "Scenarios": [
        ["A title"],
        ["SCENARIO_ID", "Situation", "INTERNAL: Decision Flow", "Escalate?", "REPLY TEMPLATES", "AI TRIGGER KEYWORDS", "Category / Key Rule"],
        ["S1", "Late parcel", "Check the carrier", "Yes - at once", "Dear customer", "late | where", "Be kind on eBay"],
        ["", "DIVIDER"],
        ["S2", "Broken lamp", "Ask for a photo of x@y.com", "No", "", "", ""],
    ],
    "Amazon matrix": [
        ["#", "Trigger Condition", "Required Action", "Escalate To", "Response Time"],
        ["1", "Legal threat", "Stop", "Manager", "1 hour"],
    ],
    "Banned": [["#", "Category", "Banned phrase", "Why", "Use instead"], ["1", "Tone", "calm down", "rude", "I see"]],
    "Glossary": [["Term", "Full Definition", "Used In"], ["SKU", "unit", "all"]],
}


def test_workbook_to_scoped_rules(spark, tmp_path):
    write_workbook(tmp_path / "Book.xlsx", SHEETS)
    cells = workbooks.read_workbooks(spark, str(tmp_path)).cache()
    assert cells.where("sheet = 'Banned'").count() == 10
    skipped = rules.labelled_rows(cells).where("layout is null").collect()
    assert [r["sheet"] for r in skipped] == ["Glossary"]
    found = rules.unique_rules(rules.extracted_rules(cells, {"Book.xlsx": "After Sales"})).cache()
    by = {r["rule_name"]: r for r in found.collect()}
    assert set(by) == {"S1", "S2", "Legal threat", "calm down"}
    late = by["S1"]
    assert late["rule_requirement"] == "Late parcel" and late["subcategory"] == "Scenarios"
    assert late["source_row"] == 3 and late["triggers"] == ["late", "where"] and late["escalation_required"] and late["example"] == "Dear customer"
    assert by["Legal threat"]["agent_action"] == "Stop Escalate to: Manager Response time: 1 hour" and by["Legal threat"]["priority"] < 100
    assert by["calm down"]["dont_instruction"] == "calm down" and by["calm down"]["replacement_instruction"] == "I see"
    clean = rules.scrubbed(found, ["rule_name", "agent_action"])
    assert clean.count() == 3
    mine = {r["title"]: r for r in rules.scoped(clean, "eBay").collect()}
    assert set(mine) == {"S1", "calm down"}
    assert mine["S1"]["ref"].startswith("AFTSAL-") and mine["S1"]["ref"].endswith("-3")
    assert mine["S1"]["text"] == "Late parcel\nKEY RULE: Be kind on eBay\nACTION: Check the carrier\nESCALATE."
    assert {r["title"] for r in rules.scoped(clean, "temu").collect()} == {"calm down"}
    assert rules.scoped(clean, None).count() == 3 and rules.repeated_refs(rules.scoped(clean, None)).count() == 0
    assert rules.extracted_rules(cells, {}).count() == 0
    counts = rules.scope_counts(clean, "ebay").first()
    assert (counts["kept"], counts["dropped"], counts["shared"], counts["areas"]) == (2, 1, 0, 1)
    report = rules.import_report(found.unionByName(found), found).first()
    assert (report["rules"], report["duplicates"], report["triggers"], report["escalations"]) == (4, 4, 2, 2)
    assert sum(r["rules"] for r in rules.type_counts(found).collect()) == 4


def cells_of(spark, file, sheets):
    rows = [
        (file, sheet, r, c, value)
        for sheet, grid in sheets.items() for r, row in enumerate(grid, 1) for c, value in enumerate(row) if value
    ]
    return spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string")


#: The header rows by which the four layouts are known, and one that is none of them.
SCENARIO = ["SCENARIO_ID", "Situation — What the Agent Sees", "INTERNAL: Decision Flow", "Escalate?", "REPLY TEMPLATES", "AI TRIGGER KEYWORDS", "Category /\nKey Rule"]
ESCALATION = ["#", "Trigger Condition", "Required Action", "Escalate To", "Response Time"]
BANNED = ["#", "Category", "❌ Banned Phrase / Word / Response", "Why It's Banned", "✅ Use This Instead"]
DO_DONT = ["#", "Category", "Rule / Requirement", "DO or DON'T"]
GLOSSARY = ["Term", "Full Definition", "Used In"]

#: A bicycle workshop's answers.
WORKSHOP = {
    "House style": [DO_DONT, ["4", "Greeting", "Name the bicycle", "DO"], ["5", "Greeting", "Guess the rider's size", "DON'T"]],
    "Words": [["Spring edition"], [], BANNED, ["2", "Claims", "unbreakable", "Frames do break", "tested to the norm"]],
    "Glossary": [GLOSSARY, ["BB", "bottom bracket", "Repairs"]],
    "Repairs": [
        ["Answers of the workshop"], ["", "Prices are in the till."], SCENARIO,
        ["W-31", "Chain slips under load", "Measure it.\nOffer a new one.", "no", "A new chain takes an hour.", "slips\nchain | jumps", "Wear parts"],
        ["Frames and forks"],
        ["W-32", "Fork has a crack", "Keep the wheel still.", "yes, before any ride", "Please don't ride it.", "crack", "Frames"],
        ["W-33", "Send the form to desk@bikes.test", "Wait", "no", "Sent.", "form", "Papers"],
        ["W-34", "Repair 55-10203-40506 is overdue", "Call", "no", "Soon.", "late", "Papers"],
    ],
    "Who decides": [ESCALATION, ["9", "Rider was hurt", "Write down the time.", "Owner", "Same day"]],
}
EMPTY_SHEET = {"S": [["Nothing here"], SCENARIO]}


def test_layouts_as_people_write_them(spark):
    cells = cells_of(spark, "Shop.xlsx", WORKSHOP)
    found = rules.extracted_rules(cells, {"Shop.xlsx": "Workshop"})
    by = {r["rule_name"]: r for r in found.collect()}
    assert set(by) == {"W-31", "W-32", "W-33", "W-34", "Rider was hurt", "unbreakable", "Name the bicycle", "Guess the rider's size"}
    chain, fork = by["W-31"], by["W-32"]
    assert chain["source_row"] == 4 and fork["source_row"] == 6 and chain["rule_type"] == "scenario"
    assert [chain["escalation_required"], fork["escalation_required"]] == [False, True]
    assert chain["triggers"] == ["slips", "chain", "jumps"] and chain["example"] == "A new chain takes an hour."
    assert (chain["rule_requirement"], chain["key_rule"], chain["category_name"]) == ("Chain slips under load", "Wear parts", "Workshop")
    word = by["unbreakable"]
    assert word["banned_phrase"] == word["dont_instruction"] == "unbreakable" and word["replacement_instruction"] == "tested to the norm"
    sides = {n: (by[n]["do_instruction"], by[n]["dont_instruction"]) for n in ("Name the bicycle", "Guess the rider's size")}
    assert sides == {"Name the bicycle": ("Name the bicycle", None), "Guess the rider's size": (None, "Guess the rider's size")}
    text = [c for c, t in found.dtypes if t == "string"]
    assert {r["rule_name"] for r in found.where(rules.personal(text)).collect()} == {"W-33", "W-34"}
    assert rules.scrubbed(found, text).count() == len(by) - 2


def test_why_sheets_give_no_rules(spark):
    files = {"Shop.xlsx": WORKSHOP, "Unmapped.xlsx": EMPTY_SHEET, "Riders.xlsx": EMPTY_SHEET}
    cells = None
    for name, sheets in files.items():
        more = cells_of(spark, name, sheets)
        cells = more if cells is None else cells.unionByName(more)
    found = {tuple(r) for r in rules.skipped_sheets(cells, {"Shop.xlsx": "Workshop"}, {"Riders.xlsx": "names of riders"}).collect()}
    assert found == {("Shop.xlsx", "Glossary", rules.NO_LAYOUT), ("Riders.xlsx", None, "names of riders"), ("Unmapped.xlsx", None, rules.NO_CATEGORY)}


def test_import_touches_what_changed(spark):
    came = rules.extracted_rules(cells_of(spark, "Shop.xlsx", WORKSHOP), {"Shop.xlsx": "Workshop"})
    came = rules.unique_rules(came.unionByName(came)).cache()
    keys = ["source_file", "source_sheet", "source_row"]
    sums = came.select(*keys, "content_checksum")
    first = rules.import_plan(sums.limit(0), came, keys)
    assert first["rules"].count() == 8 and first["categories"].count() == 1
    assert {(r["state"], r["active"]) for r in first["sources"].collect()} == {("draft", False)}
    stale = F.when(F.col("source_row") == 4, F.lit("stale")).otherwise(F.col("content_checksum"))
    again = rules.import_plan(came.select(*keys, stale.alias("content_checksum")), came, keys)
    changed = again["sources"].where("source_sheet = 'Repairs'").collect()
    assert [(r["import_action"], r["state"]) for r in changed] == [("changed", None)]
    assert sorted(r["trigger"] for r in again["triggers"].collect()) == ["chain", "jumps", "slips"] and again["examples"].count() == 1
    unchanged = rules.import_plan(sums, came, keys)
    assert {n: t.count() for n, t in unchanged.items() if n != "categories"} == dict.fromkeys(("sources", "rules", "triggers", "examples"), 0)


def scope_row(**columns):
    names = "category_name source_file source_sheet rule_name rule_requirement key_rule agent_action do_instruction dont_instruction banned_phrase replacement_instruction"
    return tuple({"category_name": "A", "source_file": "f", "rule_name": "n"}.get(c) if c not in columns else columns[c] for c in names.split()) + (3, False)


def test_marketplaces_are_kept_apart(spark):
    schema = "category_name string, source_file string, source_sheet string, rule_name string, rule_requirement string, key_rule string, agent_action string, " \
        "do_instruction string, dont_instruction string, banned_phrase string, replacement_instruction string, source_row int, escalation_required boolean"
    def one(**columns):
        return spark.createDataFrame([scope_row(**columns)], schema)

    names = ("ebay", "shopify", "Temu", "amazon", "bandq")
    kept = lambda r: {m for m in names if rules.scoped(r, m).count()}
    assert kept(one(source_sheet="Website orders", rule_requirement="Ask for the frame number.")) == {"shopify", "bandq", "Temu"}
    assert kept(one(source_sheet="Amazon parcels", rule_requirement="Ask for the frame number.")) == {"amazon"}
    assert kept(one(source_sheet="Repairs", rule_requirement="Ask for the frame number.")) == set(names)
    several = one(agent_action="On Temu send a photo, on Amazon a label.")
    assert kept(several) == {"Temu", "amazon"}
    whole = rules.scoped(several, None).first()
    assert whole["shared"] and whole["text"] == "ACTION: On Temu send a photo, on Amazon a label."
    assert rules.scope_counts(several, None).first()["shared"] == 1
    state = lambda r, m: tuple(rules.corpus_state(r, m, "the folder").first())
    assert state(several, "temu") == ("ready", None)
    assert state(several, "ebay") == ("not_configured", "the folder has no rules for ebay: drafts go without policy")
    assert state(several.limit(0), None) == ("not_configured", "the folder has no rules: drafts go without policy")
    assert state(None, "temu") == ("not_configured", "the folder can't be read: drafts go without policy")


def test_a_reference_has_one_rule(spark):
    """Rules that share a reference: the last in the order of the corpus stands for it, and a citation is
    one rule and one document."""
    fields = "ref string, title string, text string, category string, source_file string, source_sheet string, source_row int"
    rows = [(" [A-1] ", "One two", "t1", "A", "x.xlsx", "s", 9), ("A-1", "Three four", "t2", "A", "y.xlsx", "s", 12), ("A-1", "Five six", "t3", "A", None, None, None)]
    known = spark.createDataFrame(rows, fields)
    cites = spark.createDataFrame([(1, ["[A-1]", "A-1", "B-7"])], "revision_id int, refs array<string>")
    got = [tuple(r) for r in rules.resolved_citations(cites, known).orderBy("place").collect()]
    assert got == [(1, 0, "A-1", "cited", "Three four", "t2"), (1, 1, "B-7", "unresolved", None, None)]
    one = rules.evidence(cites, known).first()
    assert one["documents"] == ["y.xlsx"] and one["matched"].count('"ref"') == 1 and one["unresolved"] == ["B-7"]


def test_shared_rules_and_approval(spark):
    fields = "category_name string, source_file string, source_sheet string, source_row int, rule_name string, rule_requirement string, key_rule string, " \
        "agent_action string, do_instruction string, dont_instruction string, banned_phrase string, replacement_instruction string, escalation_required boolean"
    row = ("Area", "f", "s", 3, " ", "On eBay and Temu", *[None] * 6, False)
    one = rules.scoped(spark.createDataFrame([row], fields), "ebay").first()
    assert one["shared"] and one["title"] == "Area" and one["text"].startswith("On eBay and Temu\nAPPLIES TO SEVERAL PLATFORMS: follow only the EBAY")
    files = spark.createDataFrame([(" a.XLSX ",), ("b.xlsx",), ("c.xlsx",), (None,)], "x string")
    assert [r[0] for r in files.select(rules.approved(F.col("x"), ["A.xlsx", "b.xlsx"], ["B.xlsx"])).collect()] == [True, False, False, False]


def test_workbooks_are_read_again_when_changed(spark, tmp_path):
    write_workbook(tmp_path / "Book.xlsx", SHEETS)
    (tmp_path / "~$Book.xlsx").write_bytes(b"lock")
    cache = workbooks.WorkbookCache(spark, str(tmp_path))
    first = cache.cells()
    assert cache.cells() is first
    n = first.count()
    write_workbook(tmp_path / "Other.xlsx", {"S": [["a", "b"]]})
    assert cache.cells() is not first and cache.cells().count() == n + 2


def test_a_partition_a_sheet(spark, tmp_path, monkeypatch):
    write_workbook(tmp_path / "Book one.xlsx", SHEETS)
    write_workbook(tmp_path / "Other.xlsx", {"S": [["a", "b"], [], ["c", "d"]]})
    (tmp_path / "~$Other.xlsx").write_bytes(b"lock")
    monkeypatch.setattr(workbooks._XlsxReader, "BATCH", 2)
    found = workbooks.read_sheets(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == len(SHEETS) + 1
    want = sorted(map(tuple, workbooks.read_workbooks(spark, str(tmp_path)).collect()))
    assert sorted(map(tuple, found.drop("path").collect())) == want
    (tmp_path / "none").mkdir()
    assert workbooks.read_sheets(spark, str(tmp_path / "none")).count() == 0


def test_rows_and_cells_without_a_place_follow_the_one_before():
    body = f'<worksheet {NS}><sheetData><row r="3"><c><v>1</v></c><c r="D3"><v>2</v></c><c><v>3</v></c></row><row><c/><c><v>4</v></c></row></sheetData></worksheet>'
    assert list(workbooks._sheet_cells(io.BytesIO(body.encode()), [])) == [(3, 0, "1"), (3, 3, "2"), (3, 4, "3"), (4, 1, "4")]


def test_only_changed_workbooks_are_parsed(spark, tmp_path):
    books, one, two = tmp_path / "in", tmp_path / "in" / "One.xlsx", tmp_path / "in" / "Two.xlsx"
    books.mkdir()
    table = workbooks.CellTable(spark, str(books), str(tmp_path / "cells"))
    assert table.refresh() == {"parsed": 0, "removed": 0} and table.cells().count() == 0
    write_workbook(one, {"S": [["a", "b"], ["c"]]})
    write_workbook(two, {"S": [["x"]]})

    def there():
        return sorted(tuple(r) for r in table.cells().collect())

    assert table.refresh() == {"parsed": 2, "removed": 0}
    kept = [("One.xlsx", "S", 1, 0, "a"), ("One.xlsx", "S", 1, 1, "b"), ("One.xlsx", "S", 2, 0, "c")]
    assert there() == [*kept, ("Two.xlsx", "S", 1, 0, "x")]
    # a workbook with the length and time that it had isn't opened, whatever it holds
    seen = one.stat()
    one.write_bytes(b"x" * seen.st_size)
    os.utime(one, ns=(seen.st_atime_ns, seen.st_mtime_ns))
    write_workbook(two, {"T": [["y", "z"]]})
    assert table.refresh() == {"parsed": 1, "removed": 0}
    assert there() == [*kept, ("Two.xlsx", "T", 1, 0, "y"), ("Two.xlsx", "T", 1, 1, "z")]
    two.unlink()
    assert table.refresh() == {"parsed": 0, "removed": 1} and there() == kept
    again = workbooks.CellTable(spark, str(books), str(tmp_path / "cells"))
    assert again.refresh() == {"parsed": 0, "removed": 0} and again.cells().count() == 3


def test_documents_of_a_version_come_together(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"a{k}.md", f"text {k} é") for k in range(6)]

    def publish(rows, **options):
        df = spark.createDataFrame(rows, "name string, document string").repartition(3)
        return {r["name"]: r["action"] for r in documents.publish(df, path, **options).collect()}

    def there():
        last = documents.versions(path)[-1]
        return {p.name: p.read_text() for p in (tmp_path / "out" / f"v{last}").iterdir() if p.name != documents.LIST}

    assert publish(rows, dry_run=True) == {n: "new" for n, _ in rows} and not documents.versions(path)
    publish(rows)
    assert there() == dict(rows) and documents.versions(path) == [1]
    assert set(publish(rows).values()) == {"unchanged"} and documents.versions(path) == [1]
    # a task that fails, and two documents of one name, leave all as it was
    for bad in ([*rows[:5], ("b/c.md", "x")], [*rows, ("a0.md", "again")]):
        with pytest.raises(Exception):
            publish(bad)
        assert documents.versions(path) == [1] and there() == dict(rows)
        assert [p.name for p in (tmp_path / "out").iterdir()] == ["v1"]
    changed = [("a0.md", "other"), *rows[2:], ("n.md", None)]
    assert publish(changed) == {"a0.md": "changed", "a1.md": "removed", "n.md": "new", **{n: "unchanged" for n, _ in rows[2:]}}
    assert there() == {n: t or "" for n, t in changed} and documents.versions(path) == [1, 2]
    more = spark.createDataFrame([("z.md", "z")], "name string, document string")
    spark.dataSource.register(documents.DocumentSink)
    more.write.format("documents").mode("append").option("path", path).save()
    assert there() == {n: t or "" for n, t in [*changed, ("z.md", "z")]}


def test_documents_leave_out_files_that_are_not_approved(spark):
    rows = [("A-1", "t", "x", "One", f, "s", 2) for f in (" A.xlsx ", "b.xlsx", None)]
    corpus = spark.createDataFrame(rows, "ref string, title string, text string, category string, source_file string, source_sheet string, source_row int")
    assert rules.area_documents(corpus).first()["rules"] == 3
    (one,) = rules.area_documents(corpus, ["a.xlsx", "b.xlsx"], ["B.XLSX"]).collect()
    assert one["rules"] == 1 and "A.xlsx" in one["document"] and rules.area_documents(corpus, []).count() == 0


def test_checked_drafts(spark):
    rows = [
        (1, '{"draft_reply": "Hi", "sources_used": [{"kind": "a", "ref": "r"}], "missing_information": [], "requires_review": false}'),
        (2, '{"draft_reply": "Your refund has been sent", "sources_used": [{"kind": "a", "ref": "r"}], "missing_information": ["x", "x"]}'),
        (3, "no json"), (4, None), (5, '{"draft_reply": " "}'),
    ]
    df = spark.createDataFrame([(*r, "") for r in rows], "k int, response string, facts_text string")
    out = {r["k"]: r for r in rules.checked_drafts(df).collect()}
    assert [out[k]["valid"] for k in range(1, 6)] == [True, True, False, False, False]
    assert [out[k]["requires_review"] for k in range(1, 6)] == [False, True, True, True, True]
    assert out[2]["missing"] == ["x"] and out[2]["claims"] == ["refund decision"]
