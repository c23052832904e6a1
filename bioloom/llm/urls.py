"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Rules name a host and a path; the longest that fits decides. The URLs that a rule decides are the labelled
ones: a bounded, hashed sample of them (``SAMPLE`` rows) trains the trees, which then judge all URLs that no
rule fits. Features are lengths, depth, digit ratio, entropy, parameter counts and the block rate of the
host's last label among the labelled URLs, with its support.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from bioloom.session import stored

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SAMPLE = 20_000
#: Least number of rows of each label among them.
LEAST_OF_LABEL = 100
TREES, DEPTH, SEED = 20, 4, 11
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "n_url", "n_host", "n_path", "n_labels", "n_depth", "n_params", "n_query", "n_hyphens",
    "digit_ratio", "entropy", "has_fragment", "is_https", "suffix_rate", "suffix_support",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none fits. Rules of one length keep their order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features and ``suffix`` to rows with ``host`` and ``path``; a null url counts as empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    letters = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1))

    def plogp(total: Column, letter: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, letter))) / n
        return total - share * F.log2(share)

    return urls.withColumns(
        {
            "n_url": F.length(text),
            "n_host": F.length("host"),
            "n_path": F.length("path"),
            "n_labels": F.regexp_count("host", F.lit(r"[^.]+")),
            "n_depth": F.regexp_count("path", F.lit(r"[^/]+")),
            "n_params": F.regexp_count(query, F.lit(r"[^&]+")),
            "n_query": F.length(query),
            "n_hyphens": F.regexp_count(text, F.lit(r"[-_]")),
            "digit_ratio": F.regexp_count(text, F.lit("[0-9]")) / n,
            "entropy": F.aggregate(F.filter(F.array_distinct(letters), lambda c: c != ""), F.lit(0.0), plogp),
            "has_fragment": text.contains("#").cast("int"),
            "is_https": text.startswith("https").cast("int"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """How many labelled rows each suffix has and how many of them are blocked; one row a suffix."""
    return labelled.groupBy(F.col("suffix").alias("of_suffix")).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("rows"))


def with_suffix_statistics(rows: DataFrame, counts: DataFrame, own_label: Column | None = None) -> DataFrame:
    """Adds the block rate, pulled towards one half, and the support of the suffix, a row's own label left out where it has one."""
    joined = rows.join(counts, F.col("suffix") == F.col("of_suffix"), "left")
    blocked, n = F.coalesce("blocked", F.lit(0.0)), F.coalesce("rows", F.lit(0))
    if own_label is not None:
        blocked, n = blocked - own_label, n - 1
    return joined.withColumns({"suffix_rate": (blocked + 1.0) / (n + 2.0), "suffix_support": F.log1p(n)}).drop("of_suffix", "blocked", "rows")


def fit(labelled: DataFrame, key: str, sample: int = SAMPLE) -> Callable[[DataFrame], DataFrame]:
    """What adds ``model_score``, the chance that a row is to be blocked, to rows with features; learned from rows with ``label``.

    Suffix statistics count all labelled rows; the trees see about ``sample`` of them, drawn by a hash of key and url. A label too rare to
    have ``LEAST_OF_LABEL`` among these is drawn that often, or whole where it has fewer rows, so no label of the table is missed.
    """
    counts = stored(suffix_counts(labelled.select("suffix", "label")), "suffixes")
    n, blocked = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    draw = F.xxhash64(F.col(key).cast("string"), "url") / F.lit(2.0**64) + 0.5
    share = [max(sample / max(n, 1), LEAST_OF_LABEL / max(k, 1)) for k in (n - blocked, blocked)]
    drawn = stored(labelled.where(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).select("label", "suffix", *FEATURES[:-2]), "urls")
    # The sample is small and read many times; the scan that drew it ran on all tasks.
    training = with_suffix_statistics(drawn, counts, F.col("label")).coalesce(4)
    kinds = [r["label"] for r in drawn.select("label").distinct().collect()]
    if len(kinds) < 2:
        return lambda rows: with_suffix_statistics(rows, counts).withColumn("model_score", F.lit(kinds[0] if kinds else 0.0))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(assembler.transform(training).select("label", "features"))
    return lambda rows: trees.transform(assembler.transform(with_suffix_statistics(rows, counts))).withColumn("model_score", vector_to_array("probability")[1])


def parsed(pages: DataFrame, rules: tuple[tuple[str, str, str], ...], key: str, url: str) -> DataFrame:
    """Host, path, rule, what it decides (``decided``, ``label``) and the lexical features of each row."""
    rows = pages.select(F.col(key), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    return lexical(rows.withColumns({"rule": rule, "decided": decided})).withColumn("label", (F.col("decided") == "block").cast("double"))


def held_out_accuracy(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row: of a hashed fifth of the labelled URLs, how many there are and the share that trees learned from the rest judge right."""
    labelled = parsed(pages, rules, key, url).where("decided IS NOT NULL")
    out = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(5)) == 0
    judged = fit(labelled.where(~out), key)(labelled.where(out))
    return judged.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("model_score") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, key: str = "page_id", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Per row: key, ``host, path, rule, verdict`` and ``block_score`` (null where a rule decided).

    A null url, or one without ``://``, has an empty host and path, fits no rule and is left to the trees.
    Where the rules give no labels of both kinds, there is nothing to learn from: the trees' verdict is then
    the one label seen, or allow if there is none. Repeated rows give repeated results.
    """
    rows = parsed(pages, rules, key, url)
    judged = fit(rows.where("decided IS NOT NULL"), key, sample)(rows)
    open_to_model = F.col("decided").isNull()
    return judged.select(
        key, "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("model_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(open_to_model, F.col("model_score")).alias("block_score"),
    )
