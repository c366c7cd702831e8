"""URL filters by rules and a character language-model ratio.

Rules of host and path decide first. URLs that a rule accepts or rejects train two variable-order Markov models of
characters (Witten-Bell interpolation from order ORDER down to uniform). A URL that no rule fits is judged by the
difference of its log-likelihoods per character, against a cut that is calibrated on a quarter of the ruled URLs,
which the models do not learn from.

Everything is built-in functions: strings of ORDER + 1 characters are counted once, shorter ones are sums of the
longer, and every position of a URL looks up one number, so the only large exchange is keyed by such strings.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: Characters that predict the next one.
ORDER = 4
#: A model of so many strings at most is sent to every executor (about 100 bytes each); a larger one meets the URLs in a shuffle.
SENT = 1 << 18
#: Width of the steps in which cuts are tried, in nats per character.
STEP = 0.01
#: Stands before a URL and after it.
EDGE = "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, start of the path, verdict); a rule is named by host and path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the first by name."""
    out = None
    for h, p, verdict in sorted(RULES if rules is None else rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of a URL and its end: `gram`, the `order` characters before it and itself."""
    padded = F.concat(F.lit(EDGE * order), F.translate("url", UPPER, LOWER), F.lit(EDGE))
    at = F.explode(F.sequence(F.lit(1), F.length("padded") - order)).alias("at")
    return urls.withColumn("padded", padded).select("*", at).withColumn("gram", F.substring("padded", F.col("at"), order + 1)).drop("padded", "at")


def ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): difference of the two models' log-probabilities of a gram's last character after the others.

    `counted` holds (gram, yes, no): the models' counts of every gram that is to be scored, 0 included. Level by
    level a character's probability is its share after the context, mixed with the level below by the number of
    different characters that follow the context.
    """
    levels = [counted]
    for n in range(order, 0, -1):
        shorter = F.substring("gram", 2, n)
        levels.append(levels[-1].groupBy(shorter.alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    below = None
    for n, level in enumerate(reversed(levels)):
        context = W.partitionBy(F.substring("gram", 1, n)) if n else W.partitionBy(F.lit(0))
        for side in ("yes", "no"):
            level = level.withColumn(f"{side}_all", F.sum(side).over(context)).withColumn(f"{side}_kinds", F.sum((F.col(side) > 0).cast("long")).over(context))
        if below is None:
            kinds = F.count("*").over(context)
            for side in ("yes", "no"):
                level = level.withColumn(f"{side}_p", (F.col(side) + 1.0) / (F.col(f"{side}_all") + kinds + 1.0))
        else:
            level = level.withColumn("lower", F.substring("gram", 2, n)).join(below, "lower")
            for side in ("yes", "no"):
                total = F.col(f"{side}_all") + F.col(f"{side}_kinds")
                mixed = (F.col(side) + F.col(f"{side}_kinds") * F.col(f"{side}_low")) / total
                level = level.withColumn(f"{side}_p", F.when(total > 0, mixed).otherwise(F.col(f"{side}_low")))
        level = stage(level.select("gram", "yes_p", "no_p"), "level")
        below = level.select(F.col("gram").alias("lower"), F.col("yes_p").alias("yes_low"), F.col("no_p").alias("no_low"))
    return level.select("gram", (F.log("yes_p") - F.log("no_p")).alias("ratio"))


def scored(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(a, b, score): mean ratio over the characters and the end of each URL, by its hash."""
    model = F.broadcast(model) if model.count() <= SENT else model
    grams = _grams(urls.dropDuplicates(["a", "b"]), order).select("a", "b", "gram")
    return grams.join(model, "gram").groupBy("a", "b").agg(F.avg("ratio").alias("score"))


def cut(scores: DataFrame) -> DataFrame:
    """One row with the score from which a URL is accepted.

    Of the middles between neighbouring scores the one that separates accepted from rejected URLs best, both kinds
    weighing the same; of equal ones the nearest to 0. Without URLs of both kinds it is 0.
    """
    steps = scores.groupBy(F.floor(F.col("score") / STEP).alias("step"), "yes").agg(F.count("*").alias("n"))
    sides = steps.groupBy("step").agg(F.sum(F.when(F.col("yes"), F.col("n")).otherwise(0)).alias("y"), F.sum(F.when(~F.col("yes"), F.col("n")).otherwise(0)).alias("n"))
    upto, every = W.partitionBy(F.lit(0)).orderBy("step").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("step").over(W.partitionBy(F.lit(0)).orderBy("step")) + 1, F.col("step"))
    rated = sides.select(
        ((before + F.col("step")) / 2).alias("step"), (F.coalesce(F.sum("n").over(upto), F.lit(0)) / F.sum("n").over(every) - F.coalesce(F.sum("y").over(upto), F.lit(0)) / F.sum("y").over(every)).alias("gain"))
    return rated.agg(F.coalesce(F.max_by(F.col("step") * STEP, F.struct("gain", -F.abs("step"))), F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=None, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row.

    `rule` is null where none fits, and then `score` is the URL's mean log-ratio and the verdict is allow from the
    calibrated cut on. A null or empty URL has host, path and score empty and is judged like a URL without
    characters: by its end alone. Without ruled URLs every other URL is allowed.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("a", F.xxhash64("url")).withColumn("b", F.xxhash64(F.lit("url"), "url"))
    urls = rows.select("url", "a", "b", (F.col("hit.verdict") == "allow").alias("yes"), (F.pmod("a", F.lit(4)) == 0).alias("held"))
    learns = F.col("yes").isNotNull() & ~F.col("held")
    counted = _grams(urls, order).groupBy("gram").agg(
        F.sum((learns & F.col("yes")).cast("long")).alias("yes"), F.sum((learns & ~F.col("yes")).cast("long")).alias("no"))
    counted = counted.select("gram", F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("no", F.lit(0)).alias("no"))
    model = ratios(stage(counted, "grams"), order)
    asked = urls.where(F.col("yes").isNull() | F.col("held"))
    scores = stage(scored(asked, model, order), "scores")
    held = urls.where(F.col("yes").isNotNull() & F.col("held")).join(scores, ["a", "b"]).select("score", "yes")
    open_rows = rows.where(F.col("hit").isNull()).join(scores, ["a", "b"]).crossJoin(F.broadcast(cut(held)))  # one row
    judged = open_rows.select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block").alias("verdict"), "score")
    ruled = rows.where(F.col("hit").isNotNull()).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.union(judged)
