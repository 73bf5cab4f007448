"""Source rows to messages of one shape, each row with its class.

Every function adds ``row_class``: ``message``, ``notice``, ``ambiguous`` or ``unusable``; the
classes split the rows exactly, so their counts add up to the rows examined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T

# ---- fixed values ----------------------------------------------------------------------
CONSUMER_MAIL = (
    "gmail", "googlemail", "yahoo", "ymail", "rocketmail", "hotmail", "outlook", "live", "msn", "icloud", "me", "mac",
    "aol", "btinternet", "sky", "talktalk", "virginmedia", "blueyonder", "ntlworld", "tiscali", "web", "gmx",
    "t-online", "freenet", "posteo", "mailbox", "protonmail", "proton", "zoho", "orange", "wanadoo", "laposte",
    "free", "comcast", "verizon", "att", "gmail-smtp",
)
COURIERS = (
    "evri", "myhermes", "hermes", "dpd", "dpdgroup", "royalmail", "rmg", "dhl", "dhlecommerce", "ups", "fedex", "tnt",
    "yodel", "parcel2go", "parcelforce", "tuffnells", "whistl", "kitepackaging", "packlink", "shiptheory",
)
SHOP_PLATFORMS = (
    "shopify", "shopifyemail", "myshopify", "judge", "klaviyo", "mailchimp", "omnisend", "recharge", "gorgias",
    "trustpilot", "spocket",
)
OTHER_CHANNELS = (
    "ebay", "amazon", "wayfair", "faire", "onbuy", "manomano", "etsy", "bol", "avasam", "tiktok", "temu", "fruugo",
    "debenhams", "therange",
)
BOUNCE = (
    r"(?i)^\s*(mail delivery failed|undeliverable|delivery status notification|returned mail|"
    r"mail delivery subsystem|delivery has failed|unzustellbar)"
)
REPLY = r"(?i)^\s*(re|aw|antw|antwort|fwd|fw|wg|tr|rif)\s*:"
QUOTE = r"(?i)\b(quotation|quote request|request for quote|rfq|enquiry|inquiry|anfrage)\b"
#: Channel, its label, what it offers, whether both directions and the customer are certain, and
#: what its reference is called.
CAPABILITIES = (
    ("ebay", "eBay", "full", True, True, None),
    ("amazon", "Amazon", "full", True, False, "Order"),
    ("shopify", "Shopify", "full", True, False, "Order"),
    ("bandq", "B&Q", "degraded", False, False, "Order"),
    ("temu", "Temu", "degraded", False, False, None),
)
ORDER_WORD = r"(?i)order\s*#|bestellung\s*#?\s*\d"
# ----------------------------------------------------------------------------------------


def capabilities(spark: SparkSession) -> DataFrame:
    """The channels as a table, to be joined by ``marketplace``."""
    return spark.createDataFrame(
        list(CAPABILITIES), "marketplace string, label string, mode string, has_outbound boolean, verified boolean, reference_noun string"
    )


def titled(conversations: DataFrame) -> DataFrame:
    """Conversations with the ``title`` that the inbox shows."""
    names = F.broadcast(capabilities(conversations.sparkSession).drop("mode", "has_outbound"))  # a row a channel
    title = T.conversation_title(F.col("counterparty_ref"), F.col("label"), F.col("reference_noun"), F.col("verified"))
    rows = conversations.join(names, "marketplace", "left").withColumn("title", title)
    return rows.select(*conversations.columns, "title")


def _shaped(rows: DataFrame, marketplace: str, **columns: Column) -> DataFrame:
    defaults = {
        "listing_item_ref": F.lit(None).cast("string"),
        "order_ref": F.lit(None).cast("string"),
        "filter_reason": F.lit(None).cast("string"),
    }
    columns = {"marketplace": F.lit(marketplace)} | defaults | columns
    return rows.select(*(c.alias(name) for name, c in columns.items()))


def header_body_messages(rows: DataFrame, marketplace: str = "ebay") -> DataFrame:
    """Rows of headers with JSON bodies: a folder tells the direction, an item may be linked.

    A row with neither a type nor an external id is a notice, whatever else it has.
    """
    direction = F.when(F.col("folder_id") == 0, "inbound").when(F.col("folder_id") == 1, "outbound")
    other = F.when(direction == "inbound", F.col("sender_id")).when(direction == "outbound", F.col("receiver_id"))
    other = F.nullif(other, F.lit(""))
    body = T.decoded_body(F.col("body_raw"))
    item = F.col("item_id").cast("string")
    notice = F.col("message_type").isNull() & F.col("ext_message_id").isNull()
    usable = direction.isNotNull() & F.col("sub_source").isNotNull() & other.isNotNull()
    return _shaped(
        rows, marketplace,
        source_pk=F.col("id"), external_message_id=F.col("message_id"), sub_source_id=F.col("sub_source"),
        listing_item_ref=F.when(~item.isin("", "0"), item), counterparty_ref=other, direction=direction,
        source_ts=F.col("receive_date"), body_text=body["text"], body_decode_status=body["status"],
        row_class=F.when(notice, "notice").when(usable, "message").otherwise("unusable"),
    )


def relay_messages(
    rows: DataFrame,
    marketplace: str = "amazon",
    customer_domain: str = "marketplace.amazon.co.uk",
    own_domain: str = "amazon.com",
    own_name: str = "amazon.co.uk",
    notice_name: str = "seller central",
) -> DataFrame:
    """Rows of relayed mail: the sender's domain and name tell notices and the direction."""
    domain, name = T.domain_of(F.col("from_msg"), strip_bracket=False), F.lower(T.trimmed(F.col("from_name")))
    notice = F.coalesce((domain == own_domain) & F.contains(name, F.lit(notice_name)), F.lit(False))
    direction = F.when(domain == customer_domain, "inbound").when((domain == own_domain) & (name == own_name), "outbound")
    usable = F.col("sub_source").isNotNull() & direction.isNotNull()
    return _referenced(rows, marketplace, direction, F.when(notice, "notice").when(usable, "message").otherwise("unusable"))


def _referenced(rows: DataFrame, marketplace: str, direction: Column, row_class: Column, **more: Column) -> DataFrame:
    order, body = T.none_if_blank(F.col("order_id")), T.plain_body(F.col("message_content"))
    columns = dict(
        source_pk=F.col("id"), external_message_id=F.col("message_id"), sub_source_id=F.col("sub_source"), order_ref=order,
        counterparty_ref=F.coalesce(order, T.unresolved_reference(F.col("id"))), direction=direction,
        source_ts=F.col("message_date"), body_text=body["text"], body_decode_status=body["status"], row_class=row_class,
    )
    return _shaped(rows, marketplace, **(columns | more))


def inbox_filter_reason(
    company_domains: Sequence[str], order_pattern: str = ORDER_WORD, domain: Column | None = None, org: Column | None = None
) -> Column:
    """Why a mail isn't for the reply inbox; null for one that is.  The first rule that fits counts.

    ``domain`` and ``org`` are the sender's where they are columns already.
    """
    domain = T.domain_of(F.col("from_msg")) if domain is None else domain
    org = T.organisation_label(domain) if org is None else org
    subject = F.coalesce("subject", F.lit(""))
    order = T.none_if_blank(F.col("order_id")).isNotNull()
    signal = order | subject.rlike(order_pattern) | subject.rlike(REPLY) | subject.rlike(QUOTE)
    none = F.lit(None).cast("string")
    return (
        F.when(T.in_domains(domain, company_domains), none)
        .when(subject.rlike(BOUNCE), "bounce")
        .when(domain.isNull() | org.isNull(), none)
        .when(org.isin(*COURIERS), "courier")
        .when(org.isin(*SHOP_PLATFORMS), "platform")
        .when(org.isin(*OTHER_CHANNELS), "marketplace")
        .when(org.isin(*CONSUMER_MAIL) | signal, none)
        .otherwise("unsolicited")
    )


def mailbox_messages(
    rows: DataFrame, company_domains: Sequence[str], marketplace: str = "shopify", order_pattern: str = ORDER_WORD
) -> DataFrame:
    """Rows of a shared mailbox: just one side must be the company's.

    A row where both or neither are, or a side is missing, is ambiguous; that is tested
    before the account is, so an ambiguous row can lack one.
    """
    # in projections of their own, so that they are computed once a row
    rows = rows.withColumns({"_from": T.domain_of(F.col("from_msg")), "_to": T.domain_of(F.col("to_msg"))})
    rows = rows.withColumn("_org", T.organisation_label(F.col("_from")))
    sides = F.col("_from"), F.col("_to")
    ours, theirs = (T.in_domains(d, company_domains) for d in sides)
    known = sides[0].isNotNull() & sides[1].isNotNull()
    direction = F.when(known & ours & ~theirs, "outbound").when(known & ~ours & theirs, "inbound")
    row_class = F.when(direction.isNull(), "ambiguous").when(F.col("sub_source").isNull(), "unusable").otherwise("message")
    reason = inbox_filter_reason(company_domains, order_pattern, F.col("_from"), F.col("_org"))
    return _referenced(rows, marketplace, direction, row_class, filter_reason=reason)


def inbound_messages(rows: DataFrame, marketplace: str, by_order: bool) -> DataFrame:
    """Rows that are all inbound; ``by_order`` tells whether an order number joins them."""
    row_class = F.when(F.col("sub_source").isNull(), "unusable").otherwise("message")
    more = {} if by_order else {"counterparty_ref": T.unresolved_reference(F.col("id"))}
    return _referenced(rows, marketplace, F.lit("inbound"), row_class, **more)


def class_counts(rows: DataFrame) -> DataFrame:
    """One row: how many rows were examined and how many are of each class."""
    kinds = ("message", "notice", "ambiguous", "unusable")
    return rows.agg(
        F.count("*").alias("examined"), *(F.count_if(F.col("row_class") == k).alias(k) for k in kinds)
    )
