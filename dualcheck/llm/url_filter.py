"""URL filters: listed rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the start of a path; it fits the host and all its
subdomains, and the longest rule wins. What rules decide is the labelled data:
a bounded sample of it trains gradient-boosted trees, which judge the URLs that
no rule fits. Features are length, depth, digit ratio, entropy, parameter
counts and statistics of the host's suffix over the whole table: its share of
rows and its number of hosts. None of them counts labels, which a suffix would
only hand on to its other URLs.

All of it is DataFrame and SQL functions and Spark's own trees, in the JVM.
"""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labelled URLs that train the trees, at most: those with the smallest hashes.
SAMPLE = 20_000
TREES, DEPTH = 12, 3

FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy",
            "parameters", "parameter_chars", "has_fragment", "escapes", "suffix_share", "suffix_hosts")


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What lies between the host and the next ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. A rule is a host, a slash and the rest of a path's start."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def lexical(pages: DataFrame) -> DataFrame:
    """The columns url, host and path of ``pages`` give features that need no other row; a null url counts as empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    chars = F.length(url)
    # a URL's characters, sorted, fall into runs of equal ones: entropy from the length of each run
    runs = F.filter(F.split(F.regexp_replace(F.array_join(F.array_sort(F.split(url, "")), ""), r"(?s)(.)(?!\1)", "$1\n"), "\n"), lambda x: x != "")
    bits = F.aggregate(runs, F.lit(0.0), lambda a, x: a + F.length(x) * F.log2(F.length(x)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    host, path = F.col("host"), F.col("path")
    return pages.select(
        "*", chars.cast("double").alias("url_chars"), F.length(host).cast("double").alias("host_chars"), F.length(path).cast("double").alias("path_chars"),
        F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double").alias("depth"), F.size(F.split(host, r"\.")).cast("double").alias("labels"),
        (digits(url) / F.greatest(chars, F.lit(1))).alias("digit_ratio"), digits(host).cast("double").alias("host_digits"),
        F.length(F.regexp_replace(host, "[^-]", "")).cast("double").alias("hyphens"),
        F.when(chars > 0, F.log2(chars) - bits / chars).otherwise(0.0).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("parameters"), F.length(query).cast("double").alias("parameter_chars"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"), F.length(F.regexp_replace(url, "[^%]", "")).cast("double").alias("escapes"),
        F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0).alias("suffix"))


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE,
          trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; score is the trees' probability of block where no rule fits.

    ``rules`` maps rules to block or allow. A null url, or one without ://, has
    an empty host and path, fits no rule and is judged by the trees. Without
    labelled URLs of both kinds there is nothing to train on: the verdict is
    then that of the labels there are, and allow without any. Repeated rows and
    ids are each returned; an empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    kinds = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair)) if rules else F.create_map(F.lit(""), F.lit(""))
    base = base.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("ruled", F.element_at(kinds, F.col("rule")))
    rows = written(lexical(base), "urls")
    blocked = (F.col("ruled") == "block").cast("double")
    # hosts are counted by way of distinct pairs, so that a suffix with a third of all rows is merged before it is shuffled
    hosts = rows.groupBy("suffix", "host").agg(F.count("*").alias("n"))
    totals = rows.count() or 1  # from the files' footers
    stats = hosts.groupBy("suffix").agg((F.sum("n") / totals).alias("suffix_share"), F.log2(F.count("*") + 1.0).alias("suffix_hosts"))
    # written: few suffixes are broadcast for their known size, and with many a hot one can be split
    whole = rows.join(written(stats, "suffixes"), "suffix")
    # distinct, so that a URL that very many rows repeat takes one place of the sample
    labelled = whole.filter("ruled is not null").dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(sample)
    train = written(labelled.select(blocked.alias("label"), *FEATURES), "labelled-urls")
    labels = [r["label"] for r in train.select("label").distinct().collect()]
    if len(labels) < 2:
        score = F.lit(labels[0] if labels else 0.0)
        judged = whole
    else:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=7).fit(assembler.transform(train))
        judged = model.transform(assembler.transform(whole))
        # the margin of the summed trees, as GBTClassifier turns it into a probability
        score = 1 / (1 + F.exp(-2 * F.get(F.col("margins"), F.lit(1))))
        from pyspark.ml.functions import vector_to_array
        judged = judged.withColumn("margins", vector_to_array("rawPrediction"))
    judged = judged.withColumn("score", score)
    by_trees = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"),
                         F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))
