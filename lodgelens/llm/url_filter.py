"""URL verdicts: list rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that a rule decides. Features come from the URL's text only: lengths,
depth, digit share, character entropy, numbers of parameters, hyphens and labels, scheme, and
statistics of the host's last label over all URLs (how common it is, how often it is blocked).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host/path start) of the list in force.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: The trees are fitted on at most about this many rule-decided URLs, picked by hash.
MAX_TRAINING_URLS = 50_000
TREES, DEPTH = 15, 4
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_share", "entropy",
    "parameters", "hyphens", "is_https", "has_fragment", "file_ending", "suffix_share", "suffix_blocked",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without "://" and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the host or a parent of it and whose path starts the path."""
    found = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rest = text.partition("/")
        inside = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        found = F.when(inside & F.startswith(path, F.lit("/" + rest)), F.lit(text)).otherwise(found)
    return found


def _features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features; a null URL counts as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    share = F.transform(
        F.array_distinct(F.split(url, "")),
        lambda c: F.when(F.length(c) > 0, (n - F.length(F.replace(url, c, F.lit("")))) / n).otherwise(0.0),
    )
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_length": n,
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": count(F.col("path"), "/"),
            "labels": count(F.col("host"), ".") + 1,
            "digit_share": F.coalesce(F.try_divide(F.length(F.regexp_replace(url, "[^0-9]", "")), n), F.lit(0.0)),
            "entropy": F.coalesce(entropy, F.lit(0.0)),
            "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
            "hyphens": count(url, "-"),
            "is_https": F.startswith(url, F.lit("https://")).cast("int"),
            "has_fragment": F.contains(url, F.lit("#")).cast("int"),
            "file_ending": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        }
    )


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, block_score.

    ``rule`` is null where none fits; then the trees decide (block from 0.5 on). ``block_score`` is
    their probability of "block", null for ruled URLs. If the rules leave only one verdict to learn,
    that one is given, and "allow" if there is none. A null URL has an empty host and path and is
    judged by its features. Other columns are ignored. Fits the model when called.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*(F.lit(x) for v, text in rules for x in (text, v)))
    urls = urls.withColumn("ruled", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")]))
    urls = urls.withColumn("suffix", F.substring_index("host", ".", -1))
    blocked = (F.col("ruled") == "block").cast("double")
    # The last label of a host: common ones are long groups for plain sums, combined before the shuffle.
    per_suffix = urls.groupBy("suffix").agg(F.count("*").alias("_n"), F.count("ruled").alias("_d"), F.coalesce(F.sum(blocked), F.lit(0.0)).alias("_b"))
    total = per_suffix.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_d"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0.0))).first()
    rows, decided, bad = (float(x) for x in total)
    statistics = per_suffix.select(
        F.col("suffix").alias("_suffix"),
        (F.col("_n") / F.lit(max(rows, 1.0))).alias("suffix_share"),
        ((F.col("_b") + 10.0 * bad / max(decided, 1.0)) / (F.col("_d") + 10.0)).alias("suffix_blocked"),
    )
    known = urls.join(statistics, F.col("suffix") == F.col("_suffix"))
    result = ["page_id", "host", "path", "rule"]
    if not 0 < bad < decided:
        only = "block" if bad else "allow"
        return known.select(*result, F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_features(known))
    one_in = max(1, -(-int(decided) // MAX_TRAINING_URLS))
    picked = F.pmod(F.xxhash64("url"), F.lit(one_in)) == 0
    training = vectors.where(F.col("ruled").isNotNull() & picked).select("features", blocked.alias("label"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64).fit(training)
    judged = model.transform(vectors)
    score = vector_to_array(F.col("probability"))[1]
    return judged.select(
        *result,
        F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNull(), score).alias("block_score"),
    )
