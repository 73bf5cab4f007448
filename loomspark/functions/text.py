"""Scalar functions on message texts, addresses, keys and references, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# ---- fixed values ----------------------------------------------------------------------
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "com.au", "co.nz", "co.jp", "com.br", "co.za", "com.tr",
)
#: Lines that close a letter.
CLOSINGS = (
    "kind regards", "best regards", "warm regards", "warmest regards", "regards", "yours sincerely",
    "yours faithfully", "sincerely", "many thanks", "thanks", "thank you", "cheers", "best wishes", "all the best",
    "mit freundlichen grüßen", "mit freundlichen gruessen", "freundliche grüße", "viele grüße", "beste grüße",
    "liebe grüße", "herzliche grüße",
)
#: Words of a signature that is not a person's.
NOT_A_PERSON = (
    "team", "teams", "support", "service", "services", "centre", "center", "department", "ltd", "limited", "llc",
    "inc", "gmbh", "plc", "co", "company", "group", "sales", "marketing", "notifications", "noreply", "seller",
    "customer", "admin", "specialist", "manager",
)
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "heic", "heif")
#: Claims that a reply may make only if a fact bears them out.
CLAIMS = {
    "refund decision": r"(?i)\b(we (have|'ve)? ?(issued|processed|approved)|your refund (has|is)|i have refunded|refund (has been|is being) (issued|processed))\b",
    "replacement decision": r"(?i)\b(we (have|'ve)? ?(sent|dispatched|arranged) (you )?a replacement|replacement (has been|is being) (sent|dispatched))\b",
    "tracking number": r"(?i)\b(tracking (number|no\.?|code|reference)\s*(is|:)\s*\S+)",
    "delivery promise": r"(?i)\b(will (arrive|be delivered|be with you)\s+(on|by|tomorrow|today)|delivered (on|by)\s+\d)",
    "policy exception": r"(?i)\b(as an exception|we('| wi)ll make an exception|outside our (usual )?policy)\b",
}
#: Words of which a text that makes a claim has one, in lower case: cheaper to look for first.
CLAIM_WORDS = {
    "refund decision": ("refund", "issued", "processed", "approved"),
    "replacement decision": ("replacement",),
    "tracking number": ("tracking",),
    "delivery promise": ("will", "delivered"),
    "policy exception": ("exception", "policy"),
}
#: Platforms by the words that name them.
PLATFORMS = {
    "ebay": r"(?i)\bebay\b",
    "amazon": r"(?i)\bamazon\b|\bseller central\b|\ba-to-z\b|\basin\b",
    "shopify": r"(?i)\bshopify\b",
    "bandq": r"(?i)\bb&q\b|\bbandq\b|\bb and q\b",
    "temu": r"(?i)\btemu\b",
}
#: Shown for a body that is absent or could not be decoded.
UNAVAILABLE = "Message content unavailable"
#: Workflow states as a person would say them.
STATE_LABELS = {"received": "New", "drafting": "Draft in progress", "pending_review": "Awaiting review", "reviewed": "Reviewed"}
#: Labels that a line of a rule can start with.
LINE_LABELS = ("KEY RULE / ACTION", "KEY RULE", "ACTION", "DO NOT", "DO", "NEVER SAY", "SAY INSTEAD")
# ----------------------------------------------------------------------------------------

_BLANK = r"[\s\p{Z}\x{FEFF}]++"
# possessive, so that long texts take no deep recursion
_JSON_TEXT = r"""\A[ \t\r\n]*+(?:"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"|null)[ \t\r\n]*+\z"""


def trimmed(x: Column) -> Column:
    """Without white space of any script, or a byte-order mark, at its ends."""
    return F.regexp_replace(x, rf"\A{_BLANK}|(?<![\s\p{{Z}}\x{{FEFF}}]){_BLANK}\z", "")


def none_if_blank(x: Column) -> Column:
    """Null for blank texts; others stay untrimmed."""
    return F.when(trimmed(x) != "", x)


def collapsed(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, _BLANK, " "))


def decoded_body(raw: Column) -> Column:
    """Struct ``text, status`` of a JSON string: decoded, empty (null) or failed (anything else)."""
    value = F.try_parse_json(raw)
    kind = F.when(raw.rlike(_JSON_TEXT), F.schema_of_variant(value))
    return F.struct(
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).alias("text"),
        F.when(raw.isNull() | (kind == "VOID"), "empty").when(kind == "STRING", "decoded").otherwise("failed").alias("status"),
    )


def plain_body(raw: Column) -> Column:
    """Struct ``text, status`` of plain text: empty if null or blank, else decoded."""
    text = none_if_blank(raw)
    return F.struct(text.alias("text"), F.when(text.isNull(), "empty").otherwise("decoded").alias("status"))


def domain_of(address: Column, strip_bracket: bool = True) -> Column:
    """Lower-case domain behind the last ``@``; null where there is none."""
    tail = F.lower(trimmed(F.substring_index(address, "@", -1)))
    tail = F.regexp_replace(tail, r">\z", "") if strip_bracket else tail
    return F.when(F.contains(address, F.lit("@")) & (tail != ""), tail)


def in_domains(domain: Column, domains: Sequence[str]) -> Column:
    """Whether a domain is one of ``domains`` or below one."""
    hits = [(domain == d) | F.endswith(domain, F.lit(f".{d}")) for d in domains]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def organisation_label(domain: Column) -> Column:
    """The label before the public suffix; null if there is none."""
    two = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES)
    label = F.regexp_extract(domain, rf"(?:\A|\.)([^.]+)\.(?:{two})\z", 1)
    other = F.regexp_extract(domain, r"(?:\A|\.)([^.]+)\.[^.]+\z", 1)
    short = domain.rlike(rf"\A(?:{two})\z")
    return F.when(~short, F.coalesce(F.nullif(label, F.lit("")), F.nullif(other, F.lit(""))))


def unresolved_reference(pk: Column) -> Column:
    return F.concat(F.lit("unresolved:"), pk.cast("string"))


def is_unresolved_reference(ref: Column) -> Column:
    return F.startswith(ref, F.lit("unresolved:"))


def json_array(*parts: Column | None) -> Column:
    """Compact JSON array of strings, numbers and nulls: a key that no two lists share."""

    def one(part: Column) -> Column:
        text = F.to_json(F.array(part), {"ignoreNullFields": "false"})
        return F.coalesce(F.when(part.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2)), F.lit("null"))

    inner = F.concat_ws(",", *(F.lit("null") if p is None else one(p) for p in parts))
    return F.concat(F.lit("["), inner, F.lit("]"))


def thread_key(rule: Column, strategy: Column, sub_source: Column, listing: Column, counterparty: Column, segment: Column) -> Column:
    """Canonical key of a thread; the listing counts only where the strategy links items."""
    listing = F.when(strategy != "no_item", listing)
    return json_array(rule, strategy, sub_source.cast("bigint"), listing, counterparty, segment.cast("bigint"))


def is_shown(text: Column, status: Column) -> Column:
    return F.coalesce((status == "decoded") & (trimmed(text) != ""), F.lit(False))


def display_body(text: Column, status: Column) -> Column:
    return F.when(is_shown(text, status), text).otherwise(F.lit(UNAVAILABLE))


def preview(text: Column, status: Column, most: int = 90) -> Column:
    """A body on one line, cut to ``most`` characters; a null status means that there is no message."""
    flat = collapsed(text)
    short = F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))
    return F.when(status.isNull(), NO_MESSAGES).when(is_shown(text, status), short).otherwise(F.lit(UNAVAILABLE))


#: Words of titles that stand for what isn't known.
NO_MESSAGES, ENQUIRY, MESSAGE = "No messages", " enquiry", " message"


def conversation_title(reference: Column, label: Column, noun: Column, verified: Column) -> Column:
    """A verified handle as it is; else the channel with its order, or a plain enquiry."""
    enquiry = F.concat(label, F.lit(ENQUIRY))
    return F.when(verified, reference).when(is_unresolved_reference(reference), enquiry).otherwise(F.concat_ws(" ", label, noun, reference))


def unresolved_title(text: Column, status: Column, label: Column) -> Column:
    """Who signed a message of unknown direction, or which channel it came by."""
    return F.coalesce(F.when(is_shown(text, status), sender_name(text)), F.concat(label, F.lit(MESSAGE)))


def workflow_label(state: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in STATE_LABELS.items() for x in pair))
    return F.try_element_at(table, state)


def message_key(*identity: Column) -> Column:
    """Database, schema, table and key of a source row, for display."""
    return F.concat_ws(".", *identity)


def order_key(sub_source: Column, order: Column) -> Column:
    return F.concat(sub_source.cast("string"), F.lit(":"), order)


def message_side(direction: Column) -> Column:
    return F.when(direction == "inbound", "left").otherwise("right")


def timestamp_parts(ts: Column) -> Column:
    """Struct ``date, time`` (hours and minutes) of a naive timestamp, never converted."""
    text = ts.cast("string")
    return F.struct(F.substring(text, 1, 10).alias("date"), F.substring(text, 12, 5).alias("time"))


def sender_name(body: Column) -> Column:
    """The name after the last closing phrase that a name follows.

    A name has at most 40 characters and three words, letters only (and ``'’.-``), none of
    which names a role.
    """
    lines = F.filter(F.transform(F.split(body, "\r?\n"), trimmed), lambda x: x != "")
    closings, roles = F.array(*map(F.lit, CLOSINGS)), F.array(*map(F.lit, NOT_A_PERSON))

    def is_name(x: Column) -> Column:
        words = F.split(x, r"\s+")
        role = F.exists(words, lambda w: F.array_contains(roles, F.regexp_replace(F.lower(w), "[.'’-]", "")))
        return (F.length(x) <= 40) & x.rlike(r"\A\p{L}[\p{L}\p{M}'’.\- ]*\z") & (F.size(words) <= 3) & ~role

    pairs = F.arrays_zip(lines.alias("line"), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("next"))
    found = F.filter(
        pairs,
        lambda p: F.array_contains(closings, F.regexp_replace(F.lower(p["line"]), r"[,.!]*\z", ""))
        & F.coalesce(is_name(p["next"]), F.lit(False)),
    )
    return F.try_element_at(found, F.lit(-1))["next"]


def usable_urls(urls_json: Column) -> Column:
    """The distinct https addresses of a JSON list, in order; null if it is none."""
    items = F.try_variant_get(F.try_parse_json(urls_json), "$", "array<variant>")
    texts = F.transform(
        F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: trimmed(F.try_variant_get(v, "$", "string"))
    )
    return F.array_distinct(F.filter(texts, lambda u: u.rlike(r"(?i)\Ahttps://")))


def attachments(urls_json: Column) -> Column:
    """``url, kind, label`` of each distinct https address in a JSON list of strings."""
    good = usable_urls(urls_json)
    images = "|".join(IMAGE_EXTENSIONS)

    def show(u: Column) -> Column:
        path = F.substring_index(u, "?", 1)
        last = F.substring_index(path, "/", -1)
        name = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
        label = F.regexp_replace(name, r"(?i)\A\d{8,}_[0-9a-f]{8,}_", "")
        return F.struct(
            u.alias("url"),
            F.when(last.rlike(rf"(?i)\.({images})\z"), "image").otherwise("document").alias("kind"),
            F.when(label == "", "Attachment").otherwise(label).alias("label"),
        )

    return F.coalesce(F.transform(good, show), F.array().cast("array<struct<url:string,kind:string,label:string>>"))


def ungrounded_claims(reply: Column, facts_text: Column) -> Column:
    """Claims of a reply for which no fact has the claim's first word."""
    facts, low = F.lower(F.coalesce(facts_text, F.lit(""))), F.lower(reply)

    def has(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    made = [
        F.when(~F.contains(facts, F.lit(claim.split(" ")[0])) & has(CLAIM_WORDS[claim]) & reply.rlike(pattern), claim)
        for claim, pattern in CLAIMS.items()
    ]
    return F.array_compact(F.array(*made))


def needs_review(asked: Column, missing: Column, sources: Column, ungrounded: Column) -> Column:
    """Whether a draft needs a person: asked for, facts missing, nothing cited or claims ungrounded."""
    return asked | (F.size(missing) > 0) | (F.size(sources) == 0) | (F.size(ungrounded) > 0)


def normal_ref(ref: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(ref), r"\A\[+|\]+\z", ""))


def is_legacy_ref(ref: Column) -> Column:
    return ~ref.rlike(r"-\d+\z")


def same_text(a: Column, b: Column) -> Column:
    x, y = F.lower(collapsed(a)), F.lower(collapsed(b))
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def platforms_named(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), name) for name, p in PLATFORMS.items())))


def sheet_platform(sheet: Column) -> Column:
    name = F.lower(sheet)
    out = F.when(name.rlike(r"\bebay\b"), "ebay").when(name.rlike(r"\bamazon\b"), "amazon")
    return out.when(name.rlike("website|email"), "website")


def sheet_code(sheet: Column) -> Column:
    """Three base-36 digits of a polynomial hash (factor 31) of the UTF-16 code units."""
    units = F.hex(F.encode(sheet, "UTF-16BE"))
    count = (F.length(units) / 4).cast("int")
    codes = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")
    )
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(sheet == "", "000").otherwise(F.lpad(F.right(F.conv(h.cast("string"), 10, 36), F.lit(3)), 3, "0"))


def rule_ref(category: Column, sheet: Column, row: Column) -> Column:
    """``AREA-SHEET-row``: the first letters of the category's words, the sheet's code, the row."""
    words = F.split(F.regexp_replace(category, "[^A-Za-z ]", ""), r"\s+")
    area = F.substring(F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 3))), ""), 1, 6)
    return F.concat_ws("-", area, sheet_code(F.coalesce(sheet, F.lit(""))), row.cast("string"))


#: What a reviewer is told by HTTP status; None stands for all others.
FAILURES = {
    400: "The draft service rejected the request as malformed.",
    401: "The draft service refused the API key. Check the server configuration.",
    403: "The draft service refused the API key. Check the server configuration.",
    404: "The configured model is not available. Check the server configuration.",
    500: "The draft service is temporarily unavailable. Try again shortly.",
    None: "The draft service rejected the request.",
}
#: What is said of a usage limit (429), with the delay or without.
LIMITED = ("The draft service has reached its usage limit. Try again ", "in about ", " seconds.", "shortly.")


def failure_text(status: Column, message: Column) -> Column:
    """What a reviewer is told of a failed call: by its HTTP status; of the service's own words only
    the delay is passed on."""
    seconds = F.regexp_extract(F.coalesce(message, F.lit("")), r"(?i)(?:retry in|try again in)\s*(\d+)", 1)
    said = F.create_map(*(x for k, v in FAILURES.items() if k is not None for x in (F.lit(k), F.lit(v))))
    # statuses of one family that have no sentence of their own share that of its first
    own = F.coalesce(F.try_element_at(said, status.cast("int")), F.when(status >= 500, F.lit(FAILURES[500])), F.lit(FAILURES[None]))
    wait = F.when(seconds != "", F.concat(F.lit(LIMITED[1]), seconds, F.lit(LIMITED[2]))).otherwise(LIMITED[3])
    return F.when(status == 429, F.concat(F.lit(LIMITED[0]), wait)).otherwise(own)


def row_checksum(cells: Column) -> Column:
    return F.sha2(F.to_json(F.transform(cells, trimmed)), 256)


@F.pandas_udf(BooleanType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.is_normalized("NFC", x))


def is_exact_sku(sku: Column) -> Column:
    """Whether a SKU came as it was written: not empty, and in composed Unicode form."""
    plain = sku.rlike(r"\A[\x00-\x7F]+\z")
    # the others only go to Python: an OR alone would send all
    other = _composed(F.when(~plain & (sku != ""), sku))
    return F.coalesce(plain | F.coalesce(other, F.lit(False)), F.lit(False))


def exact_sku(sku: Column) -> Column:
    """The SKU as it is; null if it isn't exact.  Nothing is trimmed, folded or split."""
    return F.when(is_exact_sku(sku), sku)


def same_sku(a: Column, b: Column) -> Column:
    return exact_sku(a) == exact_sku(b)


def looks_like_combo(sku: Column) -> Column:
    return F.contains(sku, F.lit("+"))


def _unlabelled(line: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(line), rf"(?i)\A(?:{'|'.join(LINE_LABELS)}):\s*", ""))


def display_title(title: Column, text: Column, category: Column) -> Column:
    """The title if it has words and is no bare code; else the rule's first line, then the title
    or the category."""
    name, first = trimmed(title), _unlabelled(F.substring_index(text, "\n", 1))
    readable = ~name.rlike(r"\A[A-Za-z]{1,6}[-_ ]?\d+[A-Za-z]?\z") & name.rlike(r"\S\s+\S")
    line = F.when(F.length(first) > 120, F.concat(F.substring(first, 1, 117), F.lit("…"))).when(first != "", first)
    return F.coalesce(F.when(readable, name), line, F.when(name != "", name), category, F.lit("CST rule"))


def condition_of(text: Column, shown_title: Column) -> Column:
    """The first line, without its label, that says something else than the shown title."""
    lines = F.transform(F.split(text, "\n"), _unlabelled)
    title = F.lower(trimmed(shown_title))
    line = F.try_element_at(F.filter(lines, lambda x: (x != "") & (F.lower(x) != title)), F.lit(1))
    return F.when(F.length(line) > 150, F.concat(F.substring(line, 1, 147), F.lit("…"))).otherwise(line)
