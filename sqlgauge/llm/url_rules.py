"""URL filters: fixed host and path rules, and rules mined from labelled pages by FP-growth.

A URL is a set of tokens: labels of its host, words of its path, names in its query. FP-growth over the token sets of
labelled pages gives combinations that imply the blocked label with enough support and confidence. They are matched by an
inverted index: each rule is listed under its rarest token, and a URL that has this token is compared with the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import work

#: (verdict, host and path) of the fixed rules.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Least share of the labelled pages, and least number of them, that a rule's tokens and label have in common.
SUPPORT = 0.002
LEAST = 10
CONFIDENCE = 0.8
#: Bytes of all tokens in an index that may be broadcast.
INDEX_BYTES = 8 << 20
SALTS = 32

_LABEL = "label:blocked"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Behind the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or url."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """Behind the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_of: Column, path_of: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits: its host or a subdomain, and its path at the front."""
    whens = []
    for verdict, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, front = text.partition("/")
        fits = ((host_of == name) | F.endswith(host_of, F.lit("." + name))) & F.startswith(path_of, F.lit(slash + front))
        whens.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))))
    return F.coalesce(*whens)


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: host labels, path words with digits as 0, query names, whether there is a fragment."""
    text = F.coalesce(url, F.lit(""))
    named = lambda kind, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(kind), w))
    digits = F.regexp_replace(path(url), "[0-9]+", "0")
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, r"(?s)^([^=]*)", 1))
    anchor = F.when(F.contains(text, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(
        F.concat(named("host:", F.split(host(url), r"\.")), named("path:", F.split(digits, r"[/.\-_]+")), named("query:", names), anchor)
    )


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Token sets of the pages that have a quality label, with the label of low quality as one more token.

    A page with several labels is blocked if any of them says so. Pages or labels without id are left out.
    """
    bad = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.col("quality").cast("int").alias("quality"))
    bad = bad.where("page_id is not null and quality is not null").groupBy("page_id").agg((F.min("quality") == 0).alias("bad"))
    sets = pages.select(F.col("page_id").cast("long").alias("page_id"), tokens(F.col("url")).alias("items")).join(bad, "page_id")
    return sets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(_LABEL)))).otherwise(F.col("items")).alias("items")).where(F.size("items") > 0)


def mined(sets: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """antecedent, confidence and support of the rules that imply the blocked label."""
    n = sets.count()
    if not n:
        return sets.select(F.col("items").alias("antecedent"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(sets)
    implied = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _LABEL))
    return implied.select("antecedent", "confidence", "support")


def index(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """Each rule under the token of its antecedent that the fewest sets have (of equals, the first by name)."""
    numbered = rules.withColumn("rule_id", F.xxhash64(F.array_sort("antecedent")))
    seen = sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = numbered.select("*", F.explode("antecedent").alias("token")).join(seen, "token")
    rarest = each.groupBy("rule_id", "antecedent", "confidence").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rarest.select("token", "antecedent", "confidence")


def matched(pages: DataFrame, listed: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """row and the matching rule of highest confidence (antecedent sorted) of each page that any rule fits.

    ``pages`` has row and items, ``listed`` is a stored index. An index of more than ``index_bytes`` isn't broadcast:
    the join is then by token and salt, so a token that a third of all pages have is spread over SALTS partitions.
    """
    each = pages.select("row", "items", F.explode("items").alias("token"))
    size = F.octet_length(F.array_join("antecedent", " ")) + F.lit(64)
    if (listed.agg(F.sum(size)).first()[0] or 0) <= index_bytes:
        both = each.join(F.broadcast(listed), "token")
    else:
        salted = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        both = salted.join(listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["token", "salt"])
    fits = both.where(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max(F.struct("confidence", (-F.size("antecedent")).alias("short"), F.array_sort("antecedent").alias("antecedent")))
    return fits.groupBy("row").agg(best.alias("best")).select("row", F.col("best.antecedent").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    support: float = SUPPORT,
    least: int = LEAST,
    confidence: float = CONFIDENCE,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and confidence of each row of a stored table.

    A fixed rule decides where one fits; elsewhere a page is blocked if a mined rule fits, and allowed otherwise. A null
    url, or one without ://, has empty host and path, fits no rule and is allowed. Repeated rows are judged alike. Without
    labels there are no mined rules. Other columns are not read; an empty table gives no rows.
    """
    row = work.unused(pages, "row")
    rows = work.numbered(pages, row).select(
        F.col(row).alias("row"),
        F.col("page_id").cast("long").alias("page_id"),
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        tokens(F.col("url")).alias("items"),
    )
    sets = work.written(labelled(pages, labels), "token_sets")
    listed = work.written(index(mined(sets, support, least, confidence), sets), "url_index")
    found = matched(rows, listed, index_bytes)
    fixed = rule(F.col("host"), F.col("path"), rules)
    return rows.join(found, "row", "left").select(
        "page_id",
        "host",
        "path",
        fixed["rule"].alias("rule"),
        F.coalesce(fixed["verdict"], F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined_rule",
        "confidence",
    )
