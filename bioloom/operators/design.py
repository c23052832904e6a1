"""Scoring, explaining and selecting designed sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bioloom.functions import residues as R



def similarity(a: str, b: str) -> float:
    """Kinship of two residues: same, same group, water-loving against water-fearing, other."""
    group = {x: g for g, members in R.GROUPS.items() for x in members}
    if a == b:
        return 1.0
    if group[a] == group[b]:
        return 0.5
    opposed = {group[a], group[b]}
    return 0.1 if "hydrophobic" in opposed and opposed & {"polar", "positive", "negative"} else 0.2


def column_sets(reference: DataFrame) -> DataFrame:
    """One row: ``sets``, the residues of each reference column up to the shortest sequence, as strings."""
    some = reference.where("seq <> ''")
    width = some.agg(F.min(F.length("seq"))).first()[0] or 0
    long = some.select(F.substring("seq", 1, width).alias("head")).distinct().select(F.posexplode(R.letters(F.col("head"))).alias("pos", "aa")).distinct()
    columns = long.groupBy("pos").agg(F.array_join(F.array_sort(F.collect_set("aa")), "").alias("set"))
    return columns.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "set"))), lambda x: x["set"]).alias("sets"))


def conservation(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``conserv``: share of residues seen in their reference column; beyond it, half the kinship to the last column.

    The reference is one row of short strings, as many as its shortest sequence has residues.
    """
    width = F.size("sets")
    head = R.letters(F.expr("substring(seq, 1, greatest(size(sets), 1))"))
    hits = F.aggregate(F.zip_with(head, "sets", lambda a, s: F.coalesce(F.instr(s, a) > 0, F.lit(False)).cast("int")), F.lit(0), lambda n, x: n + x)
    last = F.element_at("sets", -1)
    tail = R.Counted(F.col("tail_"), F.col("tail_n_"))
    kin = [R.count_of(tail, a) * F.greatest(*[F.when(F.instr(last, b) > 0, similarity(a, b)).otherwise(0.0) for b in R.AMINO]) for a in R.AMINO]
    beyond = R.total(kin)
    score = F.when(F.col("seq") == "", 0.5).when(F.length(F.col("seq")) <= width, hits / F.length(F.col("seq"))).otherwise((hits + 0.5 * beyond) / F.length(F.col("seq")))
    # The rest of a sequence is cut off once, not for each of the twenty letters.
    cut = rows.crossJoin(F.broadcast(column_sets(reference))).withColumn("tail_", F.expr("substring(seq, size(sets) + 1, length(seq))"))
    return cut.withColumn("tail_n_", R.letter_counts("tail_")).withColumn("conserv", score).drop("sets", "tail_", "tail_n_")


def score(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """All partial scores and the weighted ``overall``; a null or empty sequence scores one half throughout."""
    made = conservation(rows.withColumn("seq", F.coalesce("seq", F.lit(""))), reference).withColumn("n_", R.letter_counts("seq"))
    seq = R.Counted(F.col("seq"), F.col("n_"))
    made = made.withColumns({"fold": R.fold_score(seq), "assembly": R.assembly_score(seq), "novelty": R.novelty_score(seq), "toxic": R.safety_score(seq)}).drop("n_")
    names = list(R.OVERALL_WEIGHTS)
    made = made.withColumns({n: F.when(F.col("seq") == "", F.lit(0.5)).otherwise(F.col(n)) for n in names})
    return made.withColumn("overall", F.round(R.overall_score({n: F.col(n) for n in names}), 10))


def _named(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def explain(scored: DataFrame) -> DataFrame:
    """Adds strengths, risks and recommendations by threshold rules, joined by a bar, and the conservation class."""
    seq = R.Counted(F.col("seq"), F.col("n_"))
    h, structure, local = R.ratio(seq, R.HYDROPHOBIC), R.structure_propensity(seq), R.localization(seq)
    strengths = _named([
        ("stable_fold", F.col("fold") > 0.9), ("safe", F.col("toxic") > 0.85), ("novel", F.col("novelty") > 0.7), ("ideal_hydrophobicity", (h > 0.35) & (h < 0.55)),
        ("helical", structure["helix"] > 0.5), ("soluble", local["solubility"] > 0.7),
    ])
    risks = _named([
        ("weak_fold", F.col("fold") < 0.7), ("unsafe", F.col("toxic") < 0.6), ("no_net_charge", R.charge(seq).cast("int") == 0),
        ("disordered", structure["disorder"] > 0.5), ("unusual_length", (F.length(F.col("seq")) < 50) | (F.length(F.col("seq")) > 200)),
    ])
    advice = _named([("verify_structure", F.col("fold") < 0.8), ("check_core_residues", F.col("conserv") < 0.5), ("missing_repeat_unit", ~F.col("seq").rlike(R.MOTIFS["repeat_variant"]))])
    advice = F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("test_first")))
    return scored.withColumn("n_", R.letter_counts("seq")).withColumns({
        "strengths": F.array_join(strengths, "|"), "risks": F.array_join(risks, "|"), "recommendations": F.array_join(advice, "|"),
        "conservation": F.when(F.col("conserv") > 0.8, "high").when(F.col("conserv") > 0.5, "medium").otherwise("low"),
    }).drop("n_")


#: Rows of a chunk for each row that is wanted.
CHUNK = 32


def select_diverse(scored: DataFrame, key: str, k: int, max_identity: float, min_score: float) -> list[dict]:
    """Greedy: best first (ties: least key), each less than ``max_identity`` alike (shared prefix positions) to all taken, until ``k``.

    Candidates come to the driver in chunks of ``CHUNK * k``, best first; a chunk begins behind the last one and leaves out what is too like any
    already taken, in one comparison with all of them. Mostly the first chunk holds ``k`` that differ, and the pool is read once. If nothing
    reaches ``min_score``, the best ``3 * k`` rows are the candidates. Null scores are no candidates; null sequences are alike to none.
    """
    ordered = [F.col("overall").desc(), F.col(key)]
    pool = scored.where(F.col("overall") >= min_score)
    if pool.isEmpty():
        pool = scored.where(F.col("overall").isNotNull()).orderBy(*ordered).limit(3 * k)
    taken: list[dict] = []
    seqs: list[str | None] = []
    last = None
    while len(taken) < k:
        rest = pool if last is None else pool.where((F.col("overall") < last["overall"]) | ((F.col("overall") == last["overall"]) & (F.col(key) > last[key])))
        known = [s for s in seqs if s is not None]
        if known:
            rest = rest.where(~F.exists(F.array(*[F.lit(s) for s in known]), lambda t: F.coalesce(positional_identity(F.col("seq"), t) >= max_identity, F.lit(False))))
        chunk = rest.select(key, "seq", "overall").orderBy(*ordered).limit(CHUNK * k).collect()
        for row in chunk:
            if len(taken) < k and all(_alike(row["seq"], s) < max_identity for s in seqs):
                taken.append({key: row[key], "overall": row["overall"], "rank": len(taken) + 1})
                seqs.append(row["seq"])
        if len(chunk) < CHUNK * k:
            break
        last = chunk[-1]
    return taken


def _alike(a: str | None, b: str | None) -> float:
    n = min(len(a or ""), len(b or ""))
    return sum(x == y for x, y in zip(a, b, strict=False)) / n if n else 0.0


def positional_identity(a: Column, b: Column) -> Column:
    """Share of equal residues over the common prefix; 0 if there is none."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(R.letters(F.left(a, n)), R.letters(F.left(b, n)), lambda x, y: (x == y).cast("int"))
    return F.when(n > 0, F.aggregate(same, F.lit(0), lambda t, x: t + x) / n).otherwise(F.lit(0.0))


FEATURES = [f"x{i}" for i in range(9)]


def design_space(parts: DataFrame) -> DataFrame:
    """Every promoter, binding site, coding sequence and terminator of ``element_type, element_id, species, strength`` with nine features.

    Combinations are the result here; libraries have a few elements of each type.
    """
    kinds = ("promoter", "rbs", "cds", "terminator")
    sets = [parts.where(F.col("element_type") == k).select(F.col("element_id").alias(k), F.col("species").alias(f"{k}_species"), F.col("strength").alias(f"s{i}")) for i, k in enumerate(kinds)]
    space = reduce(lambda a, b: a.crossJoin(b), sets)
    species = F.size(F.array_distinct(F.array(*[f"{k}_species" for k in kinds])))
    s = [F.col(f"s{i}") for i in range(4)]
    values = [*s, s[0] * s[1], s[2] * s[3], s[0] * s[2], (species - 1) * 0.12, F.lit(1.0)]
    return space.select(*kinds, *[v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)])


def target_expression() -> Column:
    # The coefficients of the simulated expression level.
    weights = {"x0": 0.55, "x1": 0.70, "x2": 0.52, "x3": 0.40, "x4": 0.34, "x5": 0.26, "x7": -0.48}
    return F.greatest(F.lit(0.02), R.total([F.col(k) * v for k, v in weights.items()]))


def ridge_fit(rows: DataFrame, y: str = "y", alpha: float = 0.15) -> list[float]:
    """Coefficients from moments summed by Spark; only nine by nine sums reach the driver."""
    import numpy as np

    n = len(FEATURES)
    moments = rows.agg(*[F.sum(F.col(a) * F.col(b)) for a in FEATURES for b in FEATURES], *[F.sum(F.col(a) * F.col(y)) for a in FEATURES]).first()
    xx, xy = np.array(moments[: n * n], float).reshape(n, n), np.array(moments[n * n :], float)
    return np.linalg.solve(xx + alpha * np.eye(n), xy).tolist()


def ridge_predict(coefficients: list[float], floor: float | None = None) -> Column:
    value = R.total([F.col(f) * c for f, c in zip(FEATURES, coefficients, strict=True)])
    return value if floor is None else F.greatest(F.lit(floor), value)
