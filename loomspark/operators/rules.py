"""A corpus of rules: from sheets of cells to scoped, rendered and citable rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators.upsert import first_by, import_status

# ---- fixed values ----------------------------------------------------------------------
#: How header cells begin, as ``header_name`` writes them, by layout; a row that has all of a
#: layout's is its header.
LAYOUTS = {
    "scenario": ("scenario_id", "situation", "escalate"),
    "escalation": ("trigger condition", "required action"),
    "banned": ("banned phrase", "use (this )?instead"),
    "do_dont": ("rule / requirement", "do or don"),
}
#: Marketplaces that rules for the website and for email serve.
WEBSITE_CHANNEL = ("shopify", "bandq", "temu")
#: Why sheets and files give no rules.
NO_LAYOUT, NO_CATEGORY = "no recognised rule-table layout", "no category mapping"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ORDER_NUMBER = r"(?<![0-9])[0-9]{2}-[0-9]{5}-[0-9]{5}(?![0-9])"
#: Added to a rule that several platforms share.
SHARED_NOTE = (
    "\nAPPLIES TO SEVERAL PLATFORMS: follow only the {} steps in this rule. "
    "Ignore every other platform's steps, links and wording."
)
#: Priority of escalation rules; others have the default.
ESCALATION_PRIORITY, DEFAULT_PRIORITY = 10, 100
# ----------------------------------------------------------------------------------------
#: Fields of rules, and how the header cells of their columns begin.
FIELDS = {
    "scenario": "scenario_id", "situation": "situation", "key_rule": "category / key rule", "internal": "internal",
    "trigger": "trigger condition", "action": "required action", "escalate_to": "escalate to", "response": "response time",
    "escalate": r"escalate\z", "keywords": "ai trigger", "template": "reply template", "banned": "banned phrase",
    "instead": "use (this )?instead", "rule": "rule / requirement", "do_dont": "do or don",
}
#: What a rule can tell to do; one that has none of these is no rule.
INSTRUCTIONS = ("rule_requirement", "key_rule", "agent_action", "do_instruction", "dont_instruction", "banned_phrase")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """``file, sheet, row, cells``: each row's cells as a map from column to trimmed text."""
    rows = cells.where(T.trimmed(F.col("value")) != "").groupBy("file", "sheet", "row")
    pairs = F.array_sort(F.collect_list(F.struct("col", T.trimmed(F.col("value")).alias("value"))))
    return rows.agg(F.map_from_entries(pairs).alias("cells"))


def header_name(cell: Column) -> Column:
    """A header cell in lower case, on one line, without the symbols around it."""
    one_line = F.regexp_replace(F.lower(cell), r"\s+", " ")
    return F.regexp_replace(one_line, r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N})]+\z", "")


def header_names(cells: Column) -> Column:
    """``header_name`` of each of some texts, as lines of one text: the patterns run once for all."""
    lines = F.replace(F.regexp_replace(F.lower(F.array_join(cells, "\x01")), r"\s+", " "), F.lit("\x01"), F.lit("\n"))
    return F.regexp_replace(lines, r"(?md)^[^\p{L}\p{N}\n]+|[^\p{L}\p{N})\n]+$", "")


def labelled_rows(cells: DataFrame) -> DataFrame:
    """``file, sheet, layout, row, cells, columns``: the rows under a sheet's header, with the columns
    that each of FIELDS has there.

    The header is the first row that has all the cells of a layout, so titles above it are
    passed over.  A sheet without one gives a single row with a null layout.  Columns are found once
    a sheet and joined to its rows, so a long sheet isn't one task.
    """
    rows = sheet_rows(cells)
    rows = rows.withColumn("_names", header_names(F.map_values("cells")))
    layout = F.lit(None).cast("string")
    for name, wanted in LAYOUTS.items():
        has = F.lit(True)
        for w in wanted:
            has = has & F.col("_names").rlike(f"(?md)^({w})")
        layout = F.coalesce(layout, F.when(has, name))
    first = F.min_by(F.struct("row", "_layout", "cells", "_names"), F.col("row")).alias("h")
    heads = rows.withColumn("_layout", layout).where(F.col("_layout").isNotNull()).groupBy("file", "sheet").agg(first)
    names = F.arrays_zip(F.map_keys("h.cells").alias("col"), F.split("h._names", "\n").alias("name"))
    heads = heads.select("file", "sheet", F.col("h.row").alias("_head"), F.col("h._layout").alias("layout"), names.alias("_names"))

    def having(pattern: str) -> Column:
        return F.transform(F.filter("_names", lambda n: n["name"].rlike(rf"\A({pattern})")), lambda n: n["col"])

    columns = F.struct(*(having(p).alias(f) for f, p in FIELDS.items()))
    heads = heads.select("file", "sheet", "_head", "layout", "_names", columns.alias("columns"))
    rows = rows.drop("_names")
    under = rows.join(heads, ["file", "sheet"]).where(F.col("row") > F.col("_head"))
    under = under.select("file", "sheet", "layout", "row", "cells", "columns", "_names")
    plain = rows.select("file", "sheet").distinct().join(heads.select("file", "sheet"), ["file", "sheet"], "left_anti")
    empty = (F.lit(None).cast(under.schema[c].dataType).alias(c) for c in under.columns[2:])
    return under.unionByName(plain.select("file", "sheet", *empty))


def _field(name: str) -> Column:
    """The first filled cell of a field's columns; there is seldom more than one."""
    columns = F.col(f"columns.{name}")
    more = F.filter(F.transform(columns, lambda c: F.try_element_at(F.col("cells"), c)), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(F.col("cells"), F.get(columns, 0)), F.when(F.size(columns) > 1, F.get(more, 0)))


def _field_values() -> Column:
    """A row's cells under a header, in order; of columns of one name the first filled one."""
    filled = F.filter("_names", lambda n: F.map_contains_key("cells", n["col"]))
    names = F.transform(filled, lambda n: n["name"])
    once = F.when(
        F.size(F.array_distinct(names)) < F.size(names),
        F.filter(filled, lambda n, i: ~F.array_contains(F.slice(names, 1, i), n["name"])),
    ).otherwise(filled)
    return F.transform(once, lambda n: F.try_element_at(F.col("cells"), n["col"]))


def extracted_rules(cells: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """Rules of the sheets of the files that ``categories`` names; others give none.

    A row without a name or without an instruction is a divider and gives no rule.  Rows with
    an email address or an order number are left out by ``scrubbed``; ``skipped_sheets`` tells
    why others gave none.
    """
    rows = labelled_rows(cells.where(F.col("file").isin(*categories))).where(F.col("layout").isNotNull())
    names = F.create_map(*(F.lit(x) for pair in categories.items() for x in pair)) if categories else F.lit(None).cast("map<string,string>")

    def by(**columns: Column) -> Column:
        out = F.lit(None).cast("string")
        for layout, column in columns.items():
            out = F.when(F.col("layout") == layout, column).otherwise(out)
        return out

    banned, keywords = _field("banned"), F.coalesce(_field("keywords"), F.lit(""))
    rule = _field("rule")
    forbids = F.coalesce(F.lower(_field("do_dont")).rlike(r"\bdon['’]?t\b|\bdo not\b"), F.lit(False))
    escalation = F.concat_ws(
        " ",
        _field("action"),
        F.concat(F.lit("Escalate to: "), _field("escalate_to")),
        F.concat(F.lit("Response time: "), _field("response")),
    )
    name = by(
        scenario=_field("scenario"), escalation=_field("trigger"), banned=banned, do_dont=rule
    )
    rules = rows.select(
        F.try_element_at(names, F.col("file")).alias("category_name"),
        F.col("file").alias("source_file"), F.col("sheet").alias("source_sheet"), F.col("row").alias("source_row"),
        T.row_checksum(_field_values()).alias("content_checksum"),
        F.col("sheet").alias("subcategory"), name.alias("rule_name"), F.col("layout").alias("rule_type"),
        by(scenario=_field("situation")).alias("rule_requirement"),
        by(scenario=_field("key_rule")).alias("key_rule"),
        by(scenario=_field("internal"), escalation=F.nullif(escalation, F.lit(""))).alias("agent_action"),
        by(do_dont=F.when(~forbids, rule)).alias("do_instruction"),
        by(do_dont=F.when(forbids, rule), banned=banned).alias("dont_instruction"),
        by(banned=banned).alias("banned_phrase"),
        by(banned=_field("instead")).alias("replacement_instruction"),
        ((F.col("layout") == "escalation") | F.coalesce(F.lower(_field("escalate")).rlike(r"\Ayes"), F.lit(False))).alias("escalation_required"),
        F.when(F.col("layout") == "escalation", ESCALATION_PRIORITY).otherwise(DEFAULT_PRIORITY).alias("priority"),
        F.filter(F.transform(F.split(keywords, r"[|\n]"), T.trimmed), lambda x: x != "").alias("triggers"),
        _field("template").alias("example"),
    ).where(F.col("rule_name").isNotNull())
    return rules.where(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in INSTRUCTIONS)).isNotNull())


def skipped_sheets(cells: DataFrame, categories: Mapping[str, str], excluded: Mapping[str, str] | None = None) -> DataFrame:
    """``file, sheet, reason``: files that ``excluded`` names, with its reason, or that have no
    category (a row each, with a null sheet), and sheets of the others without a known layout."""
    excluded = dict(excluded or {})
    files = cells.select("file").distinct()
    reasons = F.coalesce(*(F.when(F.col("file") == f, reason) for f, reason in excluded.items()), F.lit(NO_CATEGORY))
    out = files.where(F.col("file").isin(*excluded) | ~F.col("file").isin(*categories))
    out = out.select("file", F.lit(None).cast("string").alias("sheet"), reasons.alias("reason"))
    used = [f for f in categories if f not in excluded]
    plain = labelled_rows(cells.where(F.col("file").isin(*used))).where(F.col("layout").isNull())
    return out.unionByName(plain.select("file", "sheet", F.lit(NO_LAYOUT).alias("reason")))


def personal(columns: list[str]) -> Column:
    """Whether a row has an email address or an order number in any of its texts."""
    found = F.lit(False)
    for c in columns:
        # what each pattern must have is looked for first
        mail = F.contains(F.col(c), F.lit("@")) & F.col(c).rlike(EMAIL)
        order = F.contains(F.col(c), F.lit("-")) & F.col(c).rlike(ORDER_NUMBER)
        found = found | F.coalesce(mail | order, F.lit(False))
    return found


def scrubbed(rules: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without personal data; ``personal`` counts those that go."""
    return rules.where(~personal(columns))


def unique_rules(rules: DataFrame) -> DataFrame:
    """One rule for each source row and name (case and outer blanks aside)."""
    keys = ["source_file", "source_sheet", "source_row", "_name"]
    rows = rules.withColumn("_name", F.lower(F.trim("rule_name")))
    return first_by(rows, keys, "content_checksum").drop("_name")


def rule_text(
    requirement: Column, key_rule: Column, action: Column, do: Column, dont: Column, banned: Column, instead: Column, escalate: Column
) -> Column:
    """A rule as labelled lines; what repeats another part is said once."""
    key_is_requirement = T.same_text(key_rule, requirement)
    joint = ~key_is_requirement & T.same_text(key_rule, action)

    def line(label: str, value: Column, when: Column | bool = True) -> Column:
        return F.when((F.coalesce(value, F.lit("")) != "") & F.lit(when), F.concat(F.lit(label), value))

    return F.concat_ws(
        "\n",
        line("", requirement),
        F.when(joint, line("KEY RULE / ACTION: ", key_rule)).otherwise(F.when(~key_is_requirement, line("KEY RULE: ", key_rule))),
        F.when(~joint & ~T.same_text(action, requirement), line("ACTION: ", action)),
        line("DO: ", do),
        line("DO NOT: ", dont),
        line("NEVER SAY: ", banned),
        line("SAY INSTEAD: ", instead),
        F.when(escalate, "ESCALATE."),
    )


def scoped(rules: DataFrame, marketplace: str | None) -> DataFrame:
    """Rules for a marketplace, with ``ref, title, text, shared``, in order of area, sheet, row.

    A sheet of another platform goes (those for the website or email serve WEBSITE_CHANNEL), as
    does a rule that names others only; one that names several stays and is ``shared``.  Without
    a marketplace all stay.
    """
    marketplace = marketplace and marketplace.lower()
    text = rule_text(*(F.col(c) for c in (
        "rule_requirement", "key_rule", "agent_action", "do_instruction", "dont_instruction", "banned_phrase",
        "replacement_instruction", "escalation_required",
    )))
    rows = rules.withColumn("text", text)
    named = T.platforms_named(F.concat_ws(" ", "rule_name", "text"))
    rows = rows.withColumn("_named", named).withColumn("_sheet", T.sheet_platform(F.coalesce("source_sheet", F.lit(""))))
    if marketplace is not None:
        mine = (F.size("_named") == 0) | F.array_contains("_named", marketplace)
        ours = [marketplace, *["website"] * (marketplace in WEBSITE_CHANNEL)]
        own = F.col("_sheet").isNull() | F.col("_sheet").isin(*ours)
        rows = rows.where(mine & own)
    shared = F.size("_named") > 1
    note = F.when(shared & F.lit(marketplace is not None), F.lit(SHARED_NOTE.format(str(marketplace).upper()))).otherwise(F.lit(""))
    name = T.trimmed(F.coalesce("rule_name", F.lit("")))
    title = F.when(name != "", name).otherwise(F.col("category_name"))
    ref = T.rule_ref(F.col("category_name"), F.col("source_sheet"), F.col("source_row"))
    return rows.select(
        ref.alias("ref"), F.substring(title, 1, 160).alias("title"), F.concat("text", note).alias("text"),
        F.col("category_name").alias("category"), "source_file", "source_sheet", "source_row", shared.alias("shared"),
    ).orderBy("category", "source_sheet", "source_row")


def scope_counts(rules: DataFrame, marketplace: str | None) -> DataFrame:
    """One row: rules kept for a marketplace, those of others, those shared, and the areas."""
    kept = scoped(rules, marketplace).agg(
        F.count("*").alias("kept"), F.count_if("shared").alias("shared"), F.count_distinct("category").alias("areas")
    )
    return rules.agg(F.count("*").alias("_all")).crossJoin(kept).select("kept", (F.col("_all") - F.col("kept")).alias("dropped"), "shared", "areas")


def corpus_state(rules: DataFrame | None, marketplace: str | None, place: str) -> DataFrame:
    """One row ``state, reason``: ``ready``, or ``not_configured`` and why a draft then states no
    policy: ``place`` can't be read (``rules`` is None), it has no rules, or none for the marketplace."""
    if rules is None:
        spark = SparkSession.active()
        return spark.createDataFrame([("not_configured", f"{place} can't be read: drafts go without policy")], "state string, reason string")
    counts = scope_counts(rules, marketplace)
    none = F.when(F.col("kept") + F.col("dropped") == 0, F.lit(f"{place} has no rules")).when(
        F.col("kept") == 0, F.lit(f"{place} has no rules for {marketplace or 'this marketplace'}")
    )
    reason = F.concat(none, F.lit(": drafts go without policy"))
    return counts.select(F.when(none.isNull(), "ready").otherwise("not_configured").alias("state"), reason.alias("reason"))


def import_plan(known: DataFrame, came: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """What an import of ``came`` (unique rules) does to the sources ``known``, by table.

    ``sources`` are new ones, ``draft`` and inactive, and changed ones with their new checksum;
    nothing is approved or made active.  ``rules``, ``triggers`` and ``examples`` are those of new
    or changed sources only; examples replace those of their rules.  ``categories`` come once.
    """
    seen = import_status(known, came, keys).where(F.col("import_action") != "unchanged")
    state = F.when(F.col("import_action") == "new", "draft").alias("state")
    active = F.when(F.col("import_action") == "new", F.lit(False)).alias("active")
    rule_keys = [*keys, F.lower(F.trim("rule_name")).alias("rule_key")]
    return {
        "categories": came.select("category_name").distinct(),
        "sources": seen.select(*keys, "content_checksum", "import_action", state, active).distinct(),
        "rules": seen.drop("triggers", "example", "import_action"),
        "triggers": seen.select(*rule_keys, F.explode(F.array_distinct("triggers")).alias("trigger")),
        "examples": seen.where(F.col("example").isNotNull()).select(*rule_keys, "example"),
    }


def repeated_refs(rules: DataFrame) -> DataFrame:
    """References that more than one rule has: sheet codes are short, so they can clash."""
    return rules.groupBy("ref").count().where("count > 1")


def approved(file: Column, allowed: Sequence[str], forbidden: Sequence[str] = ()) -> Column:
    """Whether a file may be published: named by ``allowed`` and not by ``forbidden``, case and
    outer blanks aside."""
    name = F.lower(T.trimmed(file))
    yes, no = ([x.strip().lower() for x in names] for names in (allowed, forbidden))
    return F.coalesce(name.isin(yes) & ~name.isin(no), F.lit(False))


def withheld(allowed: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """``name, state``: allowed files that are ``missing``, and files there that are ``withheld``."""
    key = F.lower(T.trimmed(F.col(name)))
    a, p = allowed.withColumn("_key", key), present.withColumn("_key", key)
    missing = a.join(p.select("_key"), "_key", "left_anti").select(name, F.lit("missing").alias("state"))
    return missing.unionByName(p.join(a.select("_key"), "_key", "left_anti").select(name, F.lit("withheld").alias("state")))


def _in_sheet_order(part: Column) -> Column:
    """The texts of a group's rules, by sheet and row."""
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("source_sheet", F.lit("")), F.coalesce("source_row", F.lit(0)), part.alias("part"))))
    return F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n")


def _by_area(rules: DataFrame):
    return rules.groupBy(F.coalesce("category", F.lit("General")).alias("area"))


def prompt_sections(rules: DataFrame) -> DataFrame:
    """``area, section``: each area's rules under one heading, as a prompt has them."""
    part = F.concat(F.lit("["), F.col("ref"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("text"))
    bodies = _by_area(rules).agg(_in_sheet_order(part).alias("_body"))
    return bodies.select("area", F.concat(F.lit("## "), "area", F.lit("\n\n"), "_body").alias("section"))


#: What stands around an area's name and its number of rules.
DOCUMENT_HEAD = ("# CST rules — ", "\n\nApproved CST knowledge. ", " rules.\n\n")


def area_documents(rules: DataFrame, allowed: Sequence[str] | None = None, forbidden: Sequence[str] = ()) -> DataFrame:
    """``area, name, rules, document``: the rules of each area as one Markdown file.

    Each rule is a section with its reference and where it comes from, by sheet and row.  With
    ``allowed``, rules of files that aren't approved (see ``approved``) are left out.
    """
    if allowed is not None:
        rules = rules.where(approved(F.col("source_file"), allowed, forbidden))
    origin = F.concat(
        F.lit("_Source: "), F.coalesce("source_file", F.lit("unknown")),
        F.when(F.coalesce("source_sheet", F.lit("")) != "", F.concat(F.lit(" › "), "source_sheet")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" › row "), F.col("source_row").cast("string")), F.lit("")), F.lit("_"),
    )
    part = F.concat(F.lit("## ["), "ref", F.lit("] "), "title", F.lit("\n\n"), origin, F.lit("\n\n"), "text")
    bodies = _by_area(rules).agg(_in_sheet_order(part).alias("_body"), F.count("*").alias("rules"))
    bare = F.regexp_replace(F.trim(F.regexp_replace("area", "[^A-Za-z0-9 &-]", "")), r"\s+", "-")
    before, between, after = DOCUMENT_HEAD
    head = F.concat(F.lit(before), "area", F.lit(between), F.col("rules").cast("string"), F.lit(after))
    return bodies.select("area", F.concat(bare, F.lit(".md")).alias("name"), "rules", F.concat(head, "_body", F.lit("\n")).alias("document"))


def import_report(found: DataFrame, unique: DataFrame) -> DataFrame:
    """``file, rules, triggers, examples, escalations, duplicates`` of each workbook."""
    per = unique.groupBy(F.col("source_file").alias("file")).agg(
        F.count("*").alias("rules"), F.sum(F.size("triggers")).alias("triggers"), F.count("example").alias("examples"),
        F.count_if("escalation_required").alias("escalations"),
    )
    all_ = found.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("_all"))
    return per.join(all_, "file").withColumn("duplicates", F.col("_all") - F.col("rules")).drop("_all")


def import_totals(found: DataFrame, unique: DataFrame, skipped: DataFrame, scrubbed: DataFrame) -> DataFrame:
    """All of an import in one report: ``part, name, rules, triggers, examples, escalations, dropped``.

    ``part`` is ``file``, ``type``, ``category`` or ``total``; one aggregation with grouping sets counts
    all four.  ``dropped`` are a file's or all rules that repeat another.  ``scrubbed`` and ``skipped``
    are the numbers of rows (``rules``) that looked like a customer's data and of sheets without rules.
    """
    names = {"file": "source_file", "type": "rule_type", "category": "category_name"}
    rows = found.select(*names.values(), F.lit(0).alias("one"), F.lit(0).alias("triggers"), F.lit(0).alias("examples"), F.lit(0).alias("escalations"), F.lit(1).alias("all"))
    kept = unique.select(
        *names.values(), F.lit(1).alias("one"), F.coalesce(F.size("triggers"), F.lit(0)).alias("triggers"),
        F.col("example").isNotNull().cast("int").alias("examples"), F.coalesce(F.col("escalation_required"), F.lit(False)).cast("int").alias("escalations"),
        F.lit(0).alias("all"),
    )
    by = [F.col(c) for c in names.values()]
    sums = [F.sum(c).alias(n) for c, n in (("one", "rules"), ("triggers", "triggers"), ("examples", "examples"), ("escalations", "escalations"), ("all", "_all"))]
    out = rows.unionByName(kept).groupingSets([[by[0]], [by[1]], [by[2]], []], *by).agg(F.grouping_id().alias("_id"), *sums)
    # the bits of the grouping columns that a set leaves out: 3 is by file, 5 by type, 6 by category
    part = F.when(F.col("_id") == 3, "file").when(F.col("_id") == 5, "type").when(F.col("_id") == 6, "category").otherwise("total")
    named = F.coalesce(*(F.when(part == p, F.col(c)) for p, c in names.items()))
    counted = out.where((F.col("rules") > 0) | part.isin("file", "total")).select(
        part.alias("part"), named.alias("name"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rules", "triggers", "examples", "escalations")),
        F.when(part.isin("file", "total"), F.coalesce(F.col("_all") - F.col("rules"), F.lit(0))).alias("dropped"),
    )
    for name, rows in (("scrubbed", scrubbed), ("skipped", skipped)):
        nothing = (F.lit(None).cast("bigint").alias(c) for c in ("triggers", "examples", "escalations", "dropped"))
        counted = counted.unionByName(rows.agg(F.count("*").alias("rules")).select(F.lit(name).alias("part"), F.lit(None).cast("string").alias("name"), "rules", *nothing))
    return counted


def areas_in_order(rules: DataFrame, *order: str) -> DataFrame:
    """``area, place, rules, refs`` of each area, by where its first rule stands in ``order``; ``refs`` are
    its rules' references in that order.

    Only a row an area is ranked over all.
    """
    order = order or ("category", "source_sheet", "source_row")
    refs = F.transform(F.array_sort(F.collect_list(F.struct(*order, "ref"))), lambda x: x["ref"])
    per = _by_area(rules).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("rules"), refs.alias("refs"))
    place = F.row_number().over(Window.orderBy("_first", "area"))
    return per.select("area", place.alias("place"), "rules", "refs")


def type_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_type").agg(F.count("*").alias("rules")).orderBy(F.desc("rules"), "rule_type")


def by_ref(rules: DataFrame) -> DataFrame:
    """One rule for each reference, without brackets: of those that share one the last in the order of
    the corpus (area, sheet, row)."""
    order = [F.col(c) for c in ("category", "source_sheet", "source_row", "title", "text") if c in rules.columns]
    kept = [c for c in rules.columns if c != "ref"]
    last = F.max_by(F.struct(*kept), F.struct(*order)).alias("_rule")
    return rules.groupBy(T.normal_ref(F.col("ref")).alias("ref")).agg(last).select("ref", "_rule.*")


def resolved_citations(citations: DataFrame, rules: DataFrame, key: str = "revision_id", refs: str = "refs") -> DataFrame:
    """Each distinct reference of each row in order, with its rule: ``cited``, or else
    ``legacy`` (no number at its end) or ``unresolved``.  A reference has one rule (see ``by_ref``)."""
    rules = by_ref(rules)
    clean = F.array_distinct(F.transform(F.col(refs), T.normal_ref))
    rows = citations.select(key, F.posexplode(clean).alias("place", "ref")).where(F.col("ref") != "")
    found = rows.join(rules.select("ref", "title", "text", F.lit(True).alias("_hit")), "ref", "left")
    state = F.when(F.col("_hit"), "cited").when(T.is_legacy_ref(F.col("ref")), "legacy").otherwise("unresolved")
    return found.select(key, "place", "ref", state.alias("state"), "title", "text")


def evidence(citations: DataFrame, rules: DataFrame, key: str = "revision_id", refs: str = "refs") -> DataFrame:
    """``key, matched, unresolved, legacy, documents, none_matched`` of each row.

    ``matched`` is JSON: the cited rules in the order they were cited, with shown title,
    condition, text and place; a row that cites nothing is there too.  A reference has one rule
    (see ``by_ref``).
    """
    rules = by_ref(rules)
    shown = T.display_title(F.col("title"), F.col("text"), F.col("category"))
    known = rules.select(
        "ref", F.col("category").alias("area"), shown.alias("title"), T.condition_of(F.col("text"), shown).alias("condition"),
        F.col("text").alias("rule_text"), "source_file", "source_sheet", "source_row", F.lit(True).alias("_hit"),
    )
    parts = ("area", "title", "condition", "rule_text", "ref", "source_file", "source_sheet", "source_row")
    clean = F.filter(F.array_distinct(F.transform(F.col(refs), T.normal_ref)), lambda x: x != "")
    # a row that cites nothing stays, with a null reference
    rows = citations.select(key, F.posexplode_outer(clean).alias("place", "ref"))
    state = F.when(F.col("_hit"), "cited").when(T.is_legacy_ref(F.col("ref")), "legacy").otherwise("unresolved")
    found = rows.join(known, "ref", "left").withColumn("state", F.when(F.col("ref").isNotNull(), state))
    each = F.array_sort(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("place", "state", F.struct(*parts).alias("rule")))))
    out = found.groupBy(key).agg(each.alias("_all"))

    def of(wanted: str) -> Column:
        return F.transform(F.filter("_all", lambda x: x["state"] == wanted), lambda x: x["rule"])

    return out.select(
        key, F.to_json(of("cited")).alias("matched"),
        *(F.transform(of(s), lambda x: x["ref"]).alias(s) for s in ("unresolved", "legacy")),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(of("cited"), lambda x: x["source_file"])))).alias("documents"),
        (F.size(of("cited")) == 0).alias("none_matched"),
    )


def evidence_export(evidence: DataFrame, usage: DataFrame, messages: DataFrame, key: str = "revision_id") -> DataFrame:
    """Evidence with what an export adds: the call's ``provider, model, total_tokens`` and cost, how
    many rules were supplied, and the customer's last message.

    ``usage`` has a row a key with ``rules_supplied``; ``messages`` have the key, ``direction``,
    ``source_ts``.
    """
    calls = usage.select(key, "provider", "model", "total_tokens", "estimated_cost_usd", "rules_supplied")
    last = messages.where(F.col("direction") == "inbound").groupBy(key).agg(F.max("source_ts").alias("last_customer_ts"))
    cited = F.size(F.from_json("matched", "array<struct<ref:string>>"))
    out = evidence.withColumns({"cited_rules": cited, "unmatched_refs": F.size("unresolved") + F.size("legacy")})
    return out.join(calls, key, "left").join(last, key, "left")


def known_citations(citations: DataFrame, known: DataFrame | None, kind: str) -> DataFrame:
    """Citations without those of a kind whose reference isn't known; other kinds stay, and all do
    if nothing is known of it."""
    if known is None:
        return citations
    there = known.select("ref", F.lit(True).alias("_known")).distinct()
    kept = citations.join(there, "ref", "left").where((F.col("kind") != kind) | F.col("kind").isNull() | F.col("_known"))
    return kept.select(*citations.columns)


def thread_prompt(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``key, prompt``: a thread's messages, oldest first, as one text."""
    line = F.concat(F.col("direction"), F.lit(": "), F.coalesce("body_text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("source_ts", "source_pk", line.alias("line"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


#: Fact names that tell of an order; others tell of the product.
ORDER_FACT = "(?i)order|refund|tracking|delivery"


def context_blocks(
    conversations: DataFrame, facts: DataFrame, key: str = "conversation_id", order_pattern: str = ORDER_FACT,
    headings: tuple[str, str] = ("ORDER", "PRODUCT"), none_known: str = "nothing is known", listing: str = "listing",
) -> DataFrame:
    """``key, order_block, product_block``: what is known of each conversation's order and product, a line a
    fact in the order of ``facts.place``, then of the line.

    A fact is of the order if its name says so, else of the product, whose block begins with the
    conversation's ``listing_item_ref``.  A block without a line says so, so that nobody fills it in.
    """
    of_order = F.coalesce(F.rlike("name", F.lit(order_pattern)), F.lit(False))
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("value", F.lit("")))
    each = F.array_sort(F.collect_list(F.struct("place", of_order.alias("of_order"), line.alias("line"))))
    rows = conversations.select(key, "listing_item_ref").join(facts.groupBy(key).agg(each.alias("_facts")), key, "left")

    def lines(wanted: Column) -> Column:
        empty = F.array().cast("array<string>")
        return F.coalesce(F.transform(F.filter("_facts", lambda x: x["of_order"] == wanted), lambda x: x["line"]), empty)

    def block(heading: str, found: Column) -> Column:
        return F.concat(F.lit(f"{heading}:\n"), F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(none_known))

    ref = F.concat(F.lit(f"- {listing}: "), "listing_item_ref")
    product = F.array_compact(F.concat(F.array(ref), lines(F.lit(False))))
    return rows.select(key, block(headings[0], lines(F.lit(True))).alias("order_block"), block(headings[1], product).alias("product_block"))


#: Kind of citations that name a rule; others name a fact.
RULE_KIND = "cst_document"


def checked_drafts(
    responses: DataFrame, raw: str = "response", facts: str = "facts_text",
    fact_names: str | None = None, known: DataFrame | None = None, key: str = "revision_id",
) -> DataFrame:
    """Responses parsed to ``draft_reply, sources, missing, requires_review, claims, valid``.

    One that is no JSON object of the schema, or has no reply, is not ``valid``; claims
    without a fact, missing facts or no source make a review necessary.  With ``fact_names``, a
    column of names, citations are checked first, by their normal reference: one of RULE_KIND stays if
    ``known`` (unless None) has its ``ref``, any other if a fact is named so; ``key`` tells
    responses apart then.
    """
    schema = "draft_reply string, sources_used array<struct<kind:string,ref:string,label:string>>, missing_information array<string>, requires_review boolean"
    # parsed and scanned in projections of their own, so that each is done once a row
    rows, r = responses.withColumn("_draft", F.from_json(F.col(raw), schema)), F.col("_draft")
    sources = F.array_distinct(F.coalesce(r["sources_used"], F.array().cast("array<struct<kind:string,ref:string,label:string>>")))
    missing = F.array_distinct(F.coalesce(r["missing_information"], F.array().cast("array<string>")))
    claims = T.ungrounded_claims(F.coalesce(r["draft_reply"], F.lit("")), F.col(facts))
    valid = F.coalesce(T.trimmed(r["draft_reply"]) != "", F.lit(False))
    found = {"draft_reply": r["draft_reply"], "sources": sources, "missing": missing, "claims": claims, "valid": valid}
    rows = rows.withColumns(found)
    if fact_names is not None:
        rows = _checked_sources(rows, fact_names, known, key)
    review = T.needs_review(F.coalesce(r["requires_review"], F.lit(True)), *(F.col(c) for c in ("missing", "sources", "claims")))
    return rows.withColumn("requires_review", review | ~F.col("valid")).drop("_draft")


def _checked_sources(rows: DataFrame, fact_names: str, known: DataFrame | None, key: str) -> DataFrame:
    """Rows whose ``sources`` have normal references and are those that may be cited."""

    def normal(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), T.normal_ref(x["ref"]).alias("ref"), x["label"].alias("label"))

    rows = rows.withColumn("sources", F.transform("sources", normal))
    is_rule = lambda x: F.coalesce(x["kind"] == RULE_KIND, F.lit(False))
    allowed = lambda x: F.lit(True)
    if known is not None:
        # rules are met by reference, a row a citation; the rows themselves stay out of it until the end
        cited = rows.select(key, F.explode(F.filter("sources", is_rule)).alias("x")).select(key, F.col("x.ref").alias("ref"))
        there = known.select(T.normal_ref(F.col("ref")).alias("ref")).distinct()
        found = cited.join(there, "ref", "left_semi").groupBy(key).agg(F.collect_set("ref").alias("_there"))
        rows = rows.join(found, key, "left")
        allowed = lambda x: F.array_contains("_there", x["ref"])
    named = lambda x: F.array_contains(fact_names, x["ref"])
    keep = lambda x: (x["ref"] != "") & F.coalesce(F.when(is_rule(x), allowed(x)).otherwise(named(x)), F.lit(False))
    return rows.withColumn("sources", F.filter("sources", keep)).drop("_there")
