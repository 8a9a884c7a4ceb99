"""URL filter by the ratio of two character language models, with DataFrame functions only.

Host rules decide the urls they fit (longest rule first).  Every url that rules decide also
trains one of two models, accepted or rejected; the models judge the rest.  A model is a Markov
chain of variable order over ``SYMBOLS`` character classes: orders 0 to 3 are blended by
Witten-Bell, so a context leans on its longest observed suffix as far as its counts carry.  The
score of a url is the difference of both log-likelihoods divided by its number of symbols, and the
threshold is calibrated on the scores of the rule-decided urls (largest balanced accuracy; the
middle of the best thresholds).

All urls the rules decide are counted, by one grouped sum of 4-grams (``SYMBOLS**4`` = 2**20 rows at
most), of which all lower orders are sums.  The model is a table of 2**20 rows of two numbers, a
size fixed by the alphabet, and so is broadcast; a url's symbols are looked up and summed in its
own task.

Null urls and urls without ``://`` have an empty host and path and are judged by their whole text
(null: the empty text, its end symbol alone).  If either class has no urls, scores are 0 and the
threshold is 0, so the rest is allowed.  Repeated rows count and are judged each; an empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctlens.session import cut_lineage

# The rules of the query, (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SYMBOLS, ORDER = 32, 3
GRAMS = SYMBOLS ** (ORDER + 1)
_BIN = 0.005                                            # nats a symbol, of the calibration histogram
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.char_length(host) + 1, F.char_length(after)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):       # longer ones are asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(url: Column) -> Column:
    """The 4-gram code of each symbol of a url (scheme left out) and of its end.  Classes: letters
    1-26, digits 27, slash 28, dot 29, hyphen and underscore 30, all others 31; 0 pads and ends."""
    text = F.coalesce(F.regexp_replace(url, r"(?s)^.*?://", ""), F.lit(""))
    a = lambda c: F.ascii(c)
    symbol = lambda c: (F.when(a(c).between(97, 122), a(c) - 96).when(a(c).between(65, 90), a(c) - 64)
                        .when(a(c).between(48, 57), F.lit(27)).when(c == "/", F.lit(28)).when(c == ".", F.lit(29))
                        .when(c.isin("-", "_"), F.lit(30)).otherwise(F.lit(31)))
    pad = F.array(*[F.lit(0)] * ORDER)
    symbols = F.concat(pad, F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), symbol), F.array(F.lit(0)))
    # an outer array of one element computes the symbols once
    code = lambda s: F.transform(F.sequence(F.lit(ORDER), F.size(s) - 1), lambda i: sum(
        (F.get(s, i - k) * SYMBOLS ** k for k in range(1, ORDER + 1)), F.get(s, i)))
    return F.get(F.transform(F.array(symbols), code), F.lit(0))


def count_grams(labelled: DataFrame) -> DataFrame:
    """g, allow, block: 4-gram counts of urls (columns grams, verdict) by class."""
    one = lambda kind: F.sum(F.when(F.col("verdict") == kind, 1).otherwise(0)).alias(kind)
    return (labelled.select("verdict", F.explode("grams").alias("g")).groupBy("g").agg(one("allow"), one("block")))


def log_ratios(counts: DataFrame) -> DataFrame:
    """g, ratio for all 2**20 grams: log P(accepted) - log P(rejected) of the last symbol after the
    first three, in micronats."""
    spark = counts.sparkSession
    kinds = ("allow", "block")
    dense = spark.range(1).select(F.lit(0).cast("long").alias("g"), *(F.lit(1.0 / SYMBOLS).alias(f"p_{k}") for k in kinds))
    for order in range(1, ORDER + 2):                      # grams of 1, 2, 3, 4 symbols
        n = counts.groupBy((F.col("g") % SYMBOLS ** order).cast("long").alias("g")).agg(*(F.sum(k).alias(k) for k in kinds))
        context = n.groupBy(F.floor(F.col("g") / SYMBOLS).cast("long").alias("c")).agg(
            *(F.sum(k).alias(f"n_{k}") for k in kinds), *(F.sum((F.col(k) > 0).cast("int")).alias(f"t_{k}") for k in kinds))
        lower = dense.withColumnRenamed("g", "l")
        # lengths below 2**20 rows: each side's size is bounded by the alphabet
        rows = (spark.range(SYMBOLS ** order).withColumnRenamed("id", "g")
                .withColumn("c", F.floor(F.col("g") / SYMBOLS).cast("long")).withColumn("l", (F.col("g") % SYMBOLS ** (order - 1)).cast("long"))
                .join(F.broadcast(n), "g", "left").join(F.broadcast(context), "c", "left").join(F.broadcast(lower), "l"))
        blend = lambda k: F.when(F.coalesce(F.col(f"n_{k}"), F.lit(0)) > 0, (
            F.coalesce(F.col(k), F.lit(0)) + F.col(f"t_{k}") * F.col(f"p_{k}")) / (F.col(f"n_{k}") + F.col(f"t_{k}"))).otherwise(F.col(f"p_{k}"))
        dense = rows.select("g", *(blend(k).alias(f"p_{k}") for k in kinds))
    return dense.select("g", F.round((F.log("p_allow") - F.log("p_block")) * 1e6).cast("long").alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame, id_col: str = "row") -> DataFrame:
    """id_col, score: the length-normalised log-likelihood difference of each row's gram codes.  A
    row's symbols are summed in its task, so one row a url is shuffled; sums of whole micronats
    come out alike in any order."""
    return (urls.select(id_col, F.explode("grams").alias("g")).join(F.broadcast(ratios), "g")
            .groupBy(id_col).agg((F.sum("ratio") / F.count("*") / 1e6).alias("score")))


def calibrate(scored: DataFrame) -> float:
    """The threshold of largest balanced accuracy over rule-decided urls (columns score, verdict);
    between equally good ones, their middle.  Works on a histogram whose size the score's range bounds."""
    kinds = ("allow", "block")
    bins = scored.where(F.col("verdict").isNotNull()).groupBy(F.floor(F.col("score") / _BIN).alias("bin")).agg(
        *(F.sum((F.col("verdict") == k).cast("int")).alias(k) for k in kinds))
    below, every = Window.orderBy("bin"), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = (1 - (F.sum("allow").over(below) - F.col("allow")) / F.sum("allow").over(every)
            + (F.sum("block").over(below) - F.col("block")) / F.sum("block").over(every))
    # a threshold at the lower edge of a bin stands for all places from the previous bin's upper edge
    ranked = bins.select("bin", F.coalesce(F.lag("bin").over(below) + 1, F.col("bin")).alias("low"), F.round(kept, 12).alias("kept"))
    best = ranked.agg(F.max("kept").alias("k")).first()["k"]
    if best is None:
        return 0.0
    row = ranked.where(F.col("kept") == best).agg(F.min("low").alias("a"), F.max("bin").alias("b")).first()
    return (row["a"] + row["b"]) / 2 * _BIN


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold of every row."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), grams(url).alias("grams"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    base = cut_lineage(base.withColumns({"rule": rule, "verdict": verdict, "row": F.monotonically_increasing_id()}))
    counts = cut_lineage(count_grams(base.where(F.col("verdict").isNotNull())))
    seen = counts.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()
    if not seen["a"] or not seen["b"]:
        scored, threshold = base.withColumn("score", F.lit(0.0)), 0.0
    else:
        scored = cut_lineage(base.drop("grams").join(scores(base, cut_lineage(log_ratios(counts))), "row"))
        threshold = calibrate(scored)
    judged = F.coalesce("verdict", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score", F.lit(threshold).alias("threshold"))
