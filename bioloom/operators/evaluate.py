"""Judging runs of generated sequences, and small graph and ranking helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from bioloom.functions import residues as R
from bioloom.operators import align
from bioloom.session import shuffle_partitions, stored


#: Fixed statuses of the profile search, the fidelity screen and how a run is read.
PROFILE_RUN, PROFILE_NOT_RUN = "run", "not_run"
SCREEN_PASS, SCREEN_INVALID, SCREEN_UNASSESSED, SCREEN_PROFILE = "pass", "fail_invalid", "unassessed", "fail_profile"
NOT_COMPARABLE, DRIFTED, CONSERVATIVE, ELIGIBLE = "not_comparable", "drifted", "conservative", "eligible"


def _weighted(n: Column, ok: Column) -> Column:
    """The share of rows, given by their numbers, of which a flag is true; null flags are left out, and nothing has no share."""
    known = F.sum(F.when(ok.isNotNull(), n))
    return F.sum(F.when(ok, n).when(ok.isNotNull(), 0)) / F.nullif(known, F.lit(0))


def evaluate_run(generated: DataFrame, train: DataFrame, run: str, seq: str, real: DataFrame | None = None, runs: DataFrame | None = None, hits: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Per run all that needs no alignment: numbers, legality, lengths against the training set, copies of training and of any ``real``
    sequences, unique share, largest group of equals, distance of compositions and the profile hit rate.

    ``runs`` names the runs that there should be: one without sequences has nulls. ``hits`` has the ``key`` of a sequence and ``hit``, null
    where the search has no answer, which counts for neither side; without hits the rate is null. Null sequences count as empty.
    """
    generated = generated.withColumn(seq, F.coalesce(seq, F.lit("")))
    scalars = train.agg(F.min(F.length(seq)).cast("long").alias("train_length_min"), F.max(F.length(seq)).cast("long").alias("train_length_max"))
    known = train.select(F.col(seq).alias("s"), F.lit(True).alias("in_train")).unionByName((train if real is None else real).select(F.col(seq).alias("s"), F.lit(False).alias("in_train")))
    known = known.where("s IS NOT NULL").groupBy("s").agg(F.max("in_train").alias("in_train"))
    # One row for each distinct sequence of a run, with its number: all rates are weighted sums over these.
    if hits is None:
        marked = generated.withColumn("hit", F.lit(None).cast("boolean"))
    else:
        answers = hits.groupBy(F.col(key).alias("of")).agg(F.max("hit").alias("hit"))
        marked = generated.join(answers, F.col(key) == F.col("of"), "left")
    groups = marked.groupBy(run, seq).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hit"), F.count("hit").alias("n_answered"))
    joined = groups.join(known, F.col(seq) == F.col("s"), "left").crossJoin(F.broadcast(scalars))
    n, rate = F.col("n"), lambda ok: F.round(_weighted(F.col("n"), ok), 8)
    made = joined.groupBy(F.col(run).alias("run_")).agg(
        F.sum(n).alias("n_generated"), rate((F.col(seq) != "") & R.is_legal(F.col(seq))).alias("legal_char_rate"),
        rate(F.length(seq).between(F.col("train_length_min"), F.col("train_length_max"))).alias("length_in_train_range_rate"), F.round(F.sum(F.length(seq) * n) / F.sum(n), 8).alias("mean_length"),
        rate(F.coalesce("in_train", F.lit(False))).alias("exact_copy_train_rate"), rate(F.col("in_train").isNotNull()).alias("exact_copy_any_real_rate"),
        F.round(F.count(F.lit(1)) / F.sum(n), 8).alias("unique_ratio"), F.round(F.max("n") / F.sum(n), 8).alias("max_duplicate_fraction"),
        F.round(F.sum("n_hit") / F.nullif(F.sum("n_answered"), F.lit(0)), 8).alias("family_profile_hit_rate"),
    )
    apart = composition_l1(generated, train, run, seq).select(F.col(run).alias("l1_of"), F.col("l1").alias("aa_composition_l1_distance"))
    names = (generated.select(run) if runs is None else runs.select(run)).distinct()
    full = names.join(made, F.col(run) == F.col("run_"), "left").join(apart, F.col(run) == F.col("l1_of"), "left").crossJoin(F.broadcast(scalars))
    return full.drop("run_", "l1_of").withColumn("n_generated", F.coalesce("n_generated", F.lit(0))).withColumn("family_profile_status", F.lit(PROFILE_NOT_RUN if hits is None else PROFILE_RUN))


def run_report(generated: DataFrame, train: DataFrame, run: str, key: str, seq: str, real: DataFrame | None = None, runs: DataFrame | None = None, hits: DataFrame | None = None, novel: float = 0.95) -> DataFrame:
    """All figures of a run: those of ``evaluate_run``, identity to the nearest training sequence, the share below ``novel`` and the mean
    diversity of its pairs. A run without sequences has nulls."""
    plain = evaluate_run(generated, train, run, seq, real, runs, hits, key)
    near = run_identity(generated, train, run, key, seq, novel).select(
        F.col(run).alias("near_of"), F.col("mean_identity").alias("mean_nearest_train_identity"), F.col("max_identity").alias("max_nearest_train_identity"), F.col("novel_rate").alias("novel_sequence_rate")
    )
    diverse = align.pairwise_diversity(generated, run, key, seq).select(F.col(run).alias("pairs_of"), F.col("diversity").alias("mean_pairwise_diversity"))
    joined = plain.join(near, F.col(run) == F.col("near_of"), "left").join(diverse, F.col(run) == F.col("pairs_of"), "left").drop("near_of", "pairs_of")
    return joined.withColumn("novelty_threshold", F.lit(novel))


def run_identity(generated: DataFrame, train: DataFrame, run: str, key: str, seq: str, novel: float = 0.95) -> DataFrame:
    """Per run: mean and greatest identity to the nearest training sequence, and the share of sequences below ``novel``.

    Empty sequences and an empty training set have no nearest sequence: they count as novel, with identity null.
    """
    best = align.nearest_reference(generated.where(F.col(seq) != ""), train.where(F.col(seq) != ""), key, seq).select(F.col(key).alias("of"), "identity")
    joined = generated.join(best, F.col(key) == F.col("of"), "left")
    return joined.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.avg("identity").alias("mean_identity"), F.max("identity").alias("max_identity"), F.avg((F.coalesce("identity", F.lit(0.0)) < novel).cast("double")).alias("novel_rate"))


def composition(rows: DataFrame, run: str, seq: str) -> DataFrame:
    """Per run the share of each of the twenty letters among all characters."""
    counted = rows.select(run, F.length(seq).alias("length_"), R.letter_counts(seq).alias("n_"))
    return counted.groupBy(run).agg(*[(F.sum(F.col("n_")[i]) / F.sum("length_")).alias(f"p_{a}") for i, a in enumerate(R.AMINO)])


def composition_l1(generated: DataFrame, train: DataFrame, run: str, seq: str) -> DataFrame:
    q = composition(train.withColumn("all", F.lit(1)), "all", seq).drop("all")
    q = q.select(*[F.col(f"p_{a}").alias(f"q_{a}") for a in R.AMINO])
    made = composition(generated, run, seq).crossJoin(F.broadcast(q))
    return made.select(run, F.round(R.total([F.abs(F.col(f"p_{a}") - F.col(f"q_{a}")) for a in R.AMINO]), 10).alias("l1"))


def composition_zscore(rows: DataFrame, run: str, seq: str) -> DataFrame:
    """Each letter's share against the mean of the run's twenty shares, in population deviations."""
    wide = composition(rows, run, seq)
    cells = F.array(*[F.struct(F.lit(a).alias("aa"), F.col(f"p_{a}").alias("f")) for a in R.AMINO])
    long = wide.select(run, F.explode(cells).alias("x")).select(run, "x.*")
    by = Window.partitionBy(run)
    z = (F.col("f") - F.avg("f").over(by)) / F.nullif(F.stddev_pop("f").over(by), F.lit(0.0))
    return long.withColumn("z", z).select(run, "aa", F.round("f", 10).alias("f"), F.round("z", 8).alias("z"), (F.abs("z") > 2).alias("flagged"))


def window_profile(rows: DataFrame, seq: str, start: int, size: int) -> DataFrame:
    """Mean hydropathy and charge and 1 - H / log2(20) at each position of one window; H over all letters there."""
    cut = rows.where(F.length(seq) > start).select(F.posexplode(R.letters(F.substring(seq, start + 1, size))).alias("i", "aa"))
    counts = cut.groupBy((F.col("i") + start + 1).cast("long").alias("pos"), "aa").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))
    hydropathy = F.try_element_at(F.create_map(*[F.lit(x) for kv in R.HYDROPATHY.items() for x in kv]), F.col("aa"))
    charge = F.when(F.col("aa").isin(*"KRH"), 1.0).when(F.col("aa").isin(*"DE"), -1.0).otherwise(0.0)
    mean = lambda v: F.round(F.sum(F.col("n") * v) / F.sum("n"), 8)
    return shares.groupBy("pos").agg(mean(hydropathy).alias("hydropathy"), mean(charge).alias("charge"), F.round(1 - F.sum(-F.col("p") * F.log2("p")) / F.log2(F.lit(20.0)), 8).alias("conservation"))


def pareto_front(rows: DataFrame, goals: list[str]) -> DataFrame:
    """Rows that no other row matches or beats on all goals while beating on one. Runs are few; this is an anti join on dominance."""
    other = rows.select(*[F.col(g).alias(f"o_{g}") for g in goals])
    no_worse, better = F.lit(True), F.lit(False)
    for g in goals:
        no_worse, better = no_worse & (F.col(f"o_{g}") >= F.col(g)), better | (F.col(f"o_{g}") > F.col(g))
    return rows.join(other, no_worse & better, "left_anti")


def funnel(rows: DataFrame, group: str, steps: list[Column]) -> DataFrame:
    """How many rows are left after each predicate and all before it, in one pass."""
    passed, counts = F.lit(True), []
    for i, step in enumerate(steps):
        passed = passed & step
        counts.append(F.count_if(passed).alias(f"step_{i + 1}"))
    return rows.groupBy(group).agg(*counts)


def top_per_group(rows: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` best rows of each group with their place; Spark keeps at most ``n`` a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), key))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def logo(rows: DataFrame, group: str, seq: str, most: int) -> DataFrame:
    """Information content and letter heights at the first positions that all rows of a group have, ``most`` at most."""
    width = F.least(F.lit(most), F.min(F.length(seq)).over(Window.partitionBy(group)))
    cells = rows.withColumn("w", width).select(group, F.posexplode(R.letters(F.substring(F.col(seq), F.lit(1), F.col("w")))).alias("i", "aa"))
    counts = cells.groupBy(group, (F.col("i") + 1).cast("long").alias("pos"), "aa").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(group, "pos")
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(by))
    ic = F.greatest(F.lit(0.0), F.log2(F.lit(20.0)) - F.sum(-F.col("p") * F.log2("p")).over(by))
    return shares.withColumn("ic", ic).select(group, "pos", "aa", F.round("ic", 8).alias("ic"), F.round(F.col("p") * F.col("ic"), 8).alias("height"))


def valid_candidates(generated: DataFrame, reference: DataFrame, seq: str) -> DataFrame:
    """``generated`` with ``valid``: not empty, legal, and no shorter or longer than all reference sequences."""
    ends = reference.agg(F.min(F.length(seq)).alias("least_"), F.max(F.length(seq)).alias("most_"))
    ok = (F.col(seq) != "") & R.is_legal(F.col(seq)) & F.length(seq).between(F.col("least_"), F.col("most_"))
    return generated.crossJoin(F.broadcast(ends)).withColumn("valid", F.coalesce(ok, F.lit(False))).drop("least_", "most_")


def fidelity_screen(valid_rate: Column, profile_rate: Column) -> Column:
    """Whether a run may be compared: all its sequences are valid and 0.95 of them hit the profile, if that was searched."""
    return F.when(F.coalesce(valid_rate, F.lit(0.0)) != 1, SCREEN_INVALID).when(profile_rate.isNull(), SCREEN_UNASSESSED).when(profile_rate < 0.95, SCREEN_PROFILE).otherwise(SCREEN_PASS)


def interpretation(screen: Column, l1: Column, novel: Column) -> Column:
    """How a run reads: by the screen, then composition, then the share of novel sequences at 0.95."""
    return F.when(screen != SCREEN_PASS, NOT_COMPARABLE).when(l1 > 0.12, DRIFTED).when(novel < 0.10, CONSERVATIVE).otherwise(ELIGIBLE)


def screened(generated: DataFrame, reference: DataFrame, run: str, key: str, seq: str, hits: DataFrame | None = None) -> DataFrame:
    """Per run the share of valid candidates, the profile hit rate, the distance of compositions and the screen."""
    judged = valid_candidates(generated, reference, seq)
    rates = judged.groupBy(F.col(run).alias("of")).agg(F.avg(F.col("valid").cast("double")).alias("valid_candidate_rate"))
    plain = evaluate_run(generated, reference, run, seq, None, None, hits, key).select(run, "n_generated", "family_profile_hit_rate", "aa_composition_l1_distance", "exact_copy_any_real_rate", "unique_ratio", "max_duplicate_fraction")
    made = plain.join(rates, F.col(run) == F.col("of")).drop("of")
    return made.withColumn("fidelity_screen", fidelity_screen(F.col("valid_candidate_rate"), F.col("family_profile_hit_rate")))


#: References of a block that the sequences without a near one meet.
REFERENCE_BLOCK = 1024


def best_references(nodes: DataFrame, references: DataFrame, coverage: float) -> DataFrame:
    """``s, best, full``: of each distinct ``s`` the greatest identity to a reference ``t`` that covers and is covered by at least
    ``coverage`` (null without one), and the greatest full-length identity to any.

    Lengths that differ more can't be covered, so pairs meet by classes of lengths, their own and both neighbours. The full-length identity of others is below
    ``coverage`` too: only sequences that have found none of as much meet the rest, in blocks.
    """
    step = F.lit(-math.log(coverage))
    level = lambda c: F.floor(F.log(F.length(c).cast("double")) / step)
    refs = stored(references.select(F.col("t")).where("t != ''").distinct().withColumn("level", level("t")).withColumn("block", F.pmod(F.xxhash64("t"), F.lit(REFERENCE_BLOCK))), "references")
    asked = nodes.withColumn("level", F.explode(F.array(level("s") - 1, level("s"), level("s") + 1)))
    fits = F.least(F.length("s"), F.length("t")) >= coverage * F.greatest(F.length("s"), F.length("t")) - 1e-9
    tasks = shuffle_partitions(nodes.sparkSession)
    near = asked.join(refs, "level").where(fits).select("s", "t").repartition(tasks, "s", "t")
    covered = (F.col("qcov") >= coverage) & (F.col("tcov") >= coverage)
    first = align.global_identity(near, "s", "t", align.STRICT).groupBy("s").agg(F.max(F.when(covered, F.col("identity"))).alias("best"), F.max("full_identity").alias("full"))
    found = stored(nodes.join(first, "s", "left"), "near")
    blocks = refs.select("block").distinct()
    open_ = found.where(F.coalesce("full", F.lit(0.0)) < coverage).select("s")
    # Few sequences are left; each is sent once to each block of references and meets those whose length didn't fit.
    sent = open_.withColumn("all", F.lit(1)).join(blocks.withColumn("all", F.lit(1)), "all").drop("all")
    rest = sent.join(refs.select("t", "block"), "block").where(~fits).select("s", "t").repartition(tasks, "s", "t")
    other = align.global_identity(rest, "s", "t", align.STRICT).groupBy("s").agg(F.max("full_identity").alias("other"))
    return found.join(other, "s", "left").select("s", "best", F.coalesce(F.greatest("full", "other"), F.lit(0.0)).alias("full"))


def integrated(generated: DataFrame, reference: DataFrame, run: str, key: str, seq: str, hits: DataFrame | None = None, coverage: float = 0.8) -> DataFrame:
    """Per run: the screen and its figures, and of the valid candidates the mean full-length identity to the nearest reference, the shares
    without a reference of identity at least .90, .95, .98 at that coverage, and how the run reads. Runs without a valid candidate have nulls there.

    One strict alignment pass gives all three thresholds; the mean diversity of pairs is that of ``run_report``.
    """
    plain = screened(generated, reference, run, key, seq, hits)
    valid = valid_candidates(generated, reference, seq).where("valid")
    best = best_references(valid.select(F.col(seq).alias("s")).distinct(), reference.select(F.col(seq).alias("t")), coverage)
    rows = valid.join(best, F.col(seq) == F.col("s"))
    novel = lambda t: F.avg((F.coalesce("best", F.lit(0.0)) < t).cast("double"))
    found = rows.groupBy(F.col(run).alias("of")).agg(F.avg("full").alias("mean_full_identity"), novel(0.90).alias("novel_90"), novel(0.95).alias("novel_95"), novel(0.98).alias("novel_98"))
    made = plain.join(found, F.col(run) == F.col("of"), "left").drop("of")
    return made.withColumn("interpretation", interpretation(F.col("fidelity_screen"), F.col("aa_composition_l1_distance"), F.col("novel_95")))


def simple_paths(edges: DataFrame, max_length: int) -> DataFrame:
    """``source, target, nodes, strength``: each path of up to ``max_length`` edges that repeats no node, once, with the product of its weights."""
    now = edges.where("source != target").select("source", "target", F.array("source", "target").alias("nodes"), F.col("weight").alias("strength"))
    found = now
    step = edges.select(F.col("source").alias("from"), F.col("target").alias("to"), "weight")
    for _ in range(max_length - 1):
        now = now.join(step, F.col("target") == F.col("from")).where(~F.array_contains("nodes", F.col("to"))).select("source", F.col("to").alias("target"), F.concat("nodes", F.array("to")).alias("nodes"), (F.col("strength") * F.col("weight")).alias("strength"))
        found = found.unionByName(now)
    return found
