import itertools
import json

from loomspark.functions import text as T
from pyspark.sql import functions as F


def values(spark, rows, schema, *columns):
    """Results in the order of the rows."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    out = sorted(df.select("k", *(c.alias(f"c{j}") for j, c in enumerate(columns))).collect())
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]


def test_decoded_body(spark):
    good = ['"plain text"', "null", None, ' "a\\n\\u00e9" ', json.dumps('x "q"\n' * 50_000)]
    bad = ["{not json", '{"a":1}', "[1,2]", "42", '"x" y', "'x'", "NaN", "", '"open']
    out = values(spark, [(x,) for x in good + bad], "x string", T.decoded_body(F.col("x")))
    assert [r["status"] for r in out] == ["decoded", "empty", "empty", "decoded", "decoded"] + ["failed"] * len(bad)
    assert [r["text"] for r in out[:5]] == ["plain text", None, None, "a\né", 'x "q"\n' * 50_000]
    assert all(r["text"] is None for r in out[5:])


def test_thread_keys_never_clash(spark):
    odd = ["", "a", "b", '"', '","', "null", "\n", "\\", "é", "[", "a,b", "😀", " ", None]
    rows = list(itertools.product(odd, odd))
    f = T.thread_key(F.lit("r"), F.lit("item_linked"), F.lit(1), F.col("a"), F.col("b"), F.lit(0))
    out = values(spark, rows, "a string, b string", f)
    assert len(set(out)) == len(rows)
    assert [json.loads(x)[3:5] for x in out] == [list(r) for r in rows]


def test_domains(spark):
    rows = [("A <x@Mail.Shop.co.uk>",), ("a@b@c.de",), ("none",), (None,), ("x@",), ("x@shop.test",), ("x@evilshop.test",)]
    d = T.domain_of(F.col("x"))
    out = values(spark, rows, "x string", d, T.organisation_label(d), T.in_domains(d, ["shop.test"]))
    assert [r[0] for r in out] == ["mail.shop.co.uk", "c.de", None, None, None, "shop.test", "evilshop.test"]
    assert [r[1] for r in out[:2]] == ["shop", "c"]
    assert [r[2] for r in out] == [False, False, False, False, False, True, False]


def test_sender_name(spark):
    rows = [
        ("Hello\n\nKind regards,\n\nAnna Müller",),
        ("Thanks\nSales Team",),
        ("Regards\nAnna\nsome text\nThanks\nthe order 12",),
        ("no closing",),
        ("Regards",),
        (None,),
        ("Cheers!\nme@shop.test",),
    ]
    assert values(spark, rows, "x string", T.sender_name(F.col("x"))) == ["Anna Müller", None, "Anna", None, None, None, None]


def test_attachments(spark):
    name = "https://x.test/12345678_0123456789_image001.JPG?a=1"
    rows = [(json.dumps([name, " https://x.test/a%20b+c.pdf ", "http://x.test/a", 7, None, name]),), ('{"a": 1}',), (None,), ("[",)]
    out = values(spark, rows, "x string", T.attachments(F.col("x")))
    assert [tuple(a) for a in out[0]] == [
        (name, "image", "image001.JPG"),
        ("https://x.test/a%20b+c.pdf", "document", "a b+c.pdf"),
    ]
    assert out[1:] == [[], [], []]


def test_claims_and_review(spark):
    rows = [("Your refund has been sent", ""), ("Your refund has been sent", "Refund: yes"), ("Hello", ""), (None, None)]
    claims = T.ungrounded_claims(F.col("x"), F.col("y"))
    assert values(spark, rows, "x string, y string", claims) == [["refund decision"], [], [], []]


def test_references(spark):
    rows = [(" [[AB-1]] ",), ("general",)]
    out = values(spark, rows, "x string", T.normal_ref(F.col("x")), T.is_legacy_ref(T.normal_ref(F.col("x"))))
    assert out == [("AB-1", False), ("general", True)]

    def code(sheet):
        h = 0
        units = sheet.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[k : k + 2], "big")) % 2**32
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
        return out[-3:].rjust(3, "0")

    sheets = ["Rules", "Überblick", "😀 sheet", "x", ""]
    assert values(spark, [(s,) for s in sheets], "x string", T.sheet_code(F.col("x"))) == [code(s) for s in sheets]


def test_previews_and_bodies(spark):
    rows = [("a  b\n c ", "decoded"), ("x" * 91, "decoded"), (None, None), ("x" * 90, "decoded"), (None, "empty"), ("x", "failed"), (" ", "decoded")]
    out = values(spark, rows, "x string, s string", T.preview(F.col("x"), F.col("s")))
    assert out == ["a b c", "x" * 89 + "…", "No messages", "x" * 90] + [T.UNAVAILABLE] * 3
    body = values(spark, [("  ﻿",), (" a ",), (None,)], "x string", T.plain_body(F.col("x")))
    assert [tuple(b) for b in body] == [(None, "empty"), (" a ", "decoded"), (None, "empty")]


def test_titles(spark):
    rows = [("c", "eBay", None, True), ("unresolved:1", "Temu", None, False), ("A1", "B&Q", "Order", False), ("A1", "X", None, False)]
    title = T.conversation_title(*(F.col(c) for c in "rlnv"))
    assert values(spark, rows, "r string, l string, n string, v boolean", title) == ["c", "Temu enquiry", "B&Q Order A1", "X A1"]
    rows = [("EB4", "KEY RULE: Be kind\nACTION: Ask", "c"), ("Late parcel", "Late parcel\nx", "c"), ("R-WD12", "", "c"), (" ", "", None), ("One", "a" * 121, "c")]
    shown = T.display_title(F.col("t"), F.col("x"), F.col("c"))
    out = values(spark, rows, "t string, x string, c string", shown, T.condition_of(F.col("x"), shown))
    assert out == [("Be kind", "Ask"), ("Late parcel", "x"), ("R-WD12", None), ("CST rule", None), ("a" * 117 + "…", "a" * 121)]


def test_skus(spark):
    rows = [("A+B",), ("e\u0301",), ("é",), ("",), (None,), (" a",)]
    assert values(spark, rows, "x string", T.exact_sku(F.col("x"))) == ["A+B", None, "é", None, None, " a"]
    assert values(spark, rows[:2], "x string", T.looks_like_combo(F.col("x"))) == [True, False]
