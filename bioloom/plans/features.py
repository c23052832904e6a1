"""Per-sequence features and scores over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bioloom.functions import residues as R
from bioloom.operators import design, features as ops
from bioloom.plans import views
from bioloom.plans.views import RAW_SQL, SEQS_SQL, with_views

A = R.AMINO


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to ten places, for comparison."""
    return df.select(*[F.round(c, 10).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cnt(alphabet: str, s: str = "seq") -> str:
    return f"(length({s}) - length(translate({s}, '{alphabet}', '')))"


def rat(alphabet: str, s: str = "seq") -> str:
    return f"(CASE WHEN length({s}) > 0 THEN {cnt(alphabet, s)} / length({s}) ELSE 0.0 END)"


CHARS = "string_split(seq, '')"
MAXF = f"(CASE WHEN length(seq) > 0 THEN greatest({', '.join(cnt(a) for a in A)}) / length(seq) ELSE 0.0 END)"
MEANH = "((" + " + ".join(f"{cnt(a)} * {v}::DOUBLE" for a, v in R.HYDROPATHY.items()) + ") / length(seq))"
CHARGE = f"({cnt('KR')} + {cnt('H')} * 0.5::DOUBLE - {cnt('DE')})"
RUN = f"list_max(list_transform(string_split_regex(seq, '[^{R.HYDROPHOBIC}]+'), lambda x: length(x)))"


def tandem(width: int, times: int) -> str:
    same = " AND ".join(f"substr(seq, i + 1, {width}) = substr(seq, i + 1 + {width * t}, {width})" for t in range(1, times))
    return f"(len(list_filter(range(0, greatest(0, length(seq) - {width * times})), lambda i: {same})) > 0)"


def quick_tandem(width: int, times: int) -> str:
    """In one pass over the letters, for long sequences."""
    same = " AND ".join(f"c[i + {p}] = c[i + {p + width * t}]" for t in range(1, times) for p in range(width))
    return f"(len(list_filter(range(1, greatest(1, length(seq) - {width * times} + 1)), lambda i: {same})) > 0)"


NOVELTY = (
    "round(0.4 * (CASE WHEN length(seq) BETWEEN 60 AND 100 THEN 0.3 WHEN length(seq) BETWEEN 40 AND 120 THEN 0.5 ELSE 0.8 END)::DOUBLE"
    f" + 0.3 * least(1.0, {MAXF} * 3)::DOUBLE + 0.3 * (CASE WHEN {quick_tandem(3, 2)} THEN 0.7 ELSE 0.3 END)::DOUBLE, 3)"
)
FOLD = (
    "round(least(0.99, (CASE WHEN length(seq) BETWEEN 60 AND 160 THEN 0.85 WHEN length(seq) BETWEEN 40 AND 200 THEN 0.70 ELSE 0.50 END)"
    f" + CASE WHEN {rat(R.FOLD_HYDROPHOBIC)} BETWEEN 0.4 AND 0.6 THEN 0.10 ELSE 0 END)::DOUBLE, 2)"
)
H, C = rat(R.HYDROPHOBIC), rat(R.POSITIVE + R.NEGATIVE)
SAFETY = (
    f"least(0.99, greatest(0.0, 0.6 * (CASE WHEN {H} BETWEEN 0.3 AND 0.5 THEN 0.85 WHEN {H} < 0.3 THEN 0.75 ELSE greatest(0.3, 0.9 - {H}) END)::DOUBLE"
    f" + 0.4 * (1 - greatest(0.0, least(1.0, (greatest(-20.0, least(20.0, ({H} - {C}) * 20 + length(seq) / 100 * 2)) + 10) / 20)))))"
)
ASSEMBLY = (
    f"round(least(0.9, greatest(0.3, 0.5 + 0.3 * (1.0 - abs({cnt('KRH')} - {cnt('DE')}) / greatest({cnt('KRH')} + {cnt('DE')}, 1))::DOUBLE"
    f" + 0.2 * (1.0 - abs({H} - 0.45) * 2.0)::DOUBLE)), 3)"
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def counted() -> R.Counted:
    return R.Counted(F.col("seq"), F.col("n_"))


def scalar(name: str, columns, sql: str, raw: bool = False) -> None:
    def view(spark, d):
        return (views.raw_seqs if raw else views.seqs)(spark, d).withColumn("n_", R.letter_counts("seq"))

    QUERIES[name] = lambda spark, d: r6(view(spark, d).select("doc_id", *[v.alias(k) for k, v in columns().items()]))
    ORACLES[name] = f"{with_views(RAW_SQL if raw else SEQS_SQL)} SELECT doc_id, {sql} FROM {'raw_seqs' if raw else '(SELECT *, ' + CHARS + ' AS c FROM seqs)'}"


scalar(
    "valid_amino_acids", lambda: {"legal": R.is_legal(F.col("seq")), "illegal": F.array_join(R.illegal_letters(F.col("seq")), "")},
    f"regexp_full_match(seq, '[{A}]*') AS legal, array_to_string(list_sort(list_distinct(list_filter(string_split(translate(seq, '{A}', ''), ''), lambda x: x <> ''))), '') AS illegal", raw=True,
)
scalar(
    "hard_filter", lambda: {"passes": R.passes_hard_filter(counted())},
    f"CASE WHEN length(seq) BETWEEN 40 AND 300 THEN regexp_full_match(seq, '[{A}]*') AND {rat(R.HYDROPHOBIC)} <= 0.6 AND {MAXF} <= 0.3 AND NOT {tandem(3, 3)} AND NOT {tandem(4, 3)} AND NOT {tandem(5, 3)} ELSE false END AS passes", raw=True,
)
scalar("longest_hydrophobic_run", lambda: {"longest_run": R.longest_run(F.col("seq"), R.HYDROPHOBIC), "passes": R.longest_run(F.col("seq"), R.HYDROPHOBIC) <= 10}, f"{RUN}::INTEGER AS longest_run, {RUN} <= 10 AS passes")
scalar(
    "max_consecutive_repeat", lambda: {"longest_repeat": R.longest_repeat(F.col("seq"))},
    "",
)
ORACLES["max_consecutive_repeat"] = (
    f"{with_views(SEQS_SQL)}, one AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS i, unnest({CHARS}) AS x FROM seqs WHERE seq <> ''),"
    " runs AS (SELECT doc_id, x, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS g FROM one),"
    " sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id, x, g)"
    " SELECT s.doc_id, greatest(1, coalesce(max(n), 1))::INTEGER AS longest_repeat FROM seqs s LEFT JOIN sizes USING (doc_id) GROUP BY s.doc_id"
)
scalar(
    "kmer_diversity", lambda: {"diversity": R.kmer_diversity(F.col("seq"))},
    "CASE WHEN length(seq) >= 3 THEN round(len(list_distinct(list_transform(range(1, length(seq) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) / (length(seq) - 2), 10) ELSE 0.0 END::DOUBLE AS diversity",
)
OTHER = "".join(a for a in A if a not in R.HYDROPHOBIC)
FOLDED = f"string_split_regex(regexp_replace(regexp_replace(translate(seq, '{R.HYDROPHOBIC + OTHER}', '{'H' * len(R.HYDROPHOBIC) + 'P' * len(OTHER)}'), 'HP', 'H P', 'g'), 'PH', 'P H', 'g'), ' ')"
scalar(
    "blockiness", lambda: R.blockiness(F.col("seq")),
    f"CASE WHEN seq = '' THEN NULL ELSE list_max(list_transform({FOLDED}, lambda x: length(x))) END::INTEGER AS max_block, CASE WHEN seq = '' THEN NULL ELSE round(length(seq) / len({FOLDED}), 10) END AS mean_block, CASE WHEN seq = '' THEN 0 ELSE len({FOLDED}) END::INTEGER AS n_blocks",
)
scalar(
    "window_complexity", lambda: ops.window_complexity(F.col("seq"), 10),
    "round(list_avg(list_transform(range(1, length(seq) - 8), lambda i: len(list_distinct(c[i:i + 9])) / 10)), 10) AS mean_complexity, round(list_min(list_transform(range(1, length(seq) - 8), lambda i: len(list_distinct(c[i:i + 9])) / 10)), 10) AS min_complexity, greatest(0, length(seq) - 9)::INTEGER AS n_windows",
)
scalar("aa_composition", lambda: {f"f_{a}": R.ratio(counted(), a) for a in A}, ", ".join(f"round({rat(a)}, 10)::DOUBLE AS f_{a}" for a in A))
WEIGHT = " + ".join(f"{cnt(a)} * {v}" for a, v in R.SIZE.items())
PHYS = (
    f"length(seq)::INTEGER AS length, ({WEIGHT} + 110 * {cnt('BJOUXZ')} - 18 * (length(seq) - 1))::INTEGER AS molecular_weight, trunc({CHARGE})::INTEGER AS charge,"
    f" round({rat(R.HYDROPHOBIC)}, 10)::DOUBLE AS hydrophobic_ratio, round({rat(R.AROMATIC)}, 10)::DOUBLE AS aromatic_ratio, round(7.0::DOUBLE + 0.3 * ({cnt('KRH')} - {cnt('DE')}), 10)::DOUBLE AS isoelectric_point"
)
scalar("physicochemical", lambda: R.physicochemical(counted()), PHYS, raw=True)
DISORDER = f"(CASE WHEN {MEANH} < -0.5 THEN least(1.0, -{MEANH} * 0.3 + abs({CHARGE}) / length(seq)) ELSE 0.0 END)"
scalar(
    "structure_propensity", lambda: R.structure_propensity(counted()),
    f"round({rat(R.HELIX)}, 10)::DOUBLE AS helix, round({rat(R.SHEET)}, 10)::DOUBLE AS sheet, round({rat(R.TURN)}, 10)::DOUBLE AS turn, round({DISORDER}, 10)::DOUBLE AS disorder",
)
LOC = f"CASE WHEN {H} > 0.55 THEN 'Membrane' WHEN {H} > 0.4 THEN 'Cytoplasm/Membrane' ELSE 'Cytoplasm' END AS localization"
SOL = f"(CASE WHEN {H} > 0.55 THEN 0.3 WHEN {H} > 0.4 THEN 0.7 ELSE 0.9 END)::DOUBLE"
scalar(
    "localization_aggregation", lambda: R.localization(counted()),
    f"{LOC}, {SOL} AS solubility, CASE WHEN {H} > 0.6 OR {RUN} > 12 THEN 'high' WHEN {H} > 0.5 OR {RUN} > 8 THEN 'moderate' ELSE 'low' END AS aggregation",
)
scalar("score_novelty_heuristic", lambda: {"novelty": R.novelty_score(counted())}, f"{NOVELTY} AS novelty")
scalar("score_fold_heuristic", lambda: {"fold": R.fold_score(counted())}, f"{FOLD} AS fold")
scalar("score_safety", lambda: {"toxic": R.safety_score(counted())}, f"round({SAFETY}, 10)::DOUBLE AS toxic")
TOKENS = f"list_concat(list_concat([1], list_transform(list_filter({CHARS}, lambda x: x <> ''), lambda x: CASE WHEN strpos('{A}', x) > 0 THEN strpos('{A}', x) + 3 ELSE 3 END)), [2])"
scalar(
    "tokenize", lambda: ops.tokenized(F.col("seq")),
    f"len({TOKENS})::INTEGER AS n_tokens, array_to_string({TOKENS}, ' ') AS tokens, array_to_string(({TOKENS})[:-2], ' ') AS inputs, array_to_string(({TOKENS})[2:], ' ') AS labels, translate(seq, 'BJOUXZ', 'XXXXXX') AS decoded", raw=True,
)

PAIR_SQL = f"""{with_views(SEQS_SQL)}, joined AS (SELECT a.doc_id, a.seq, b.seq AS other FROM seqs a LEFT JOIN seqs b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, {ASSEMBLY} AS single, CASE WHEN length(other) > 0 AND length(seq) > 0 THEN round(least(0.95, greatest(0.3,
 0.35 * least(1.0, (least({cnt('KRH')}, {cnt('DE', 'other')}) + least({cnt('DE')}, {cnt('KRH', 'other')})) / greatest(length(seq), length(other)) * 5.0)::DOUBLE
 + 0.30 * (1.0 - abs({H} - {rat(R.HYDROPHOBIC, 'other')}))::DOUBLE + 0.20 * least(length(seq), length(other)) / greatest(length(seq), length(other))
 + 0.15 * least(1.0, ({rat('FWY')} + {rat('FWY', 'other')}) * 3.0)::DOUBLE)), 3) END::DOUBLE AS pair FROM joined"""


@query("score_assembly", PAIR_SQL)
def score_assembly(spark, d):
    one = views.seqs(spark, d)
    other = one.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("other"))
    some = (F.length("other") > 0) & (F.length("seq") > 0)
    return one.join(other, "doc_id", "left").select("doc_id", R.assembly_score(F.col("seq")).alias("single"), F.when(some, R.pair_assembly_score(F.col("seq"), F.col("other"))).alias("pair"))


def sim(a: str, b: str) -> float:
    group = {x: g for g, m in R.GROUPS.items() for x in m}
    if a == b:
        return 1.0
    if group[a] == group[b]:
        return 0.5
    return 0.1 if "hydrophobic" in (group[a], group[b]) and "special" not in (group[a], group[b]) else 0.2


SIM_SQL = ", ".join(f"('{a}', '{b}', {sim(a, b)}::DOUBLE)" for a in A for b in A)
CONSERV_CTE = f"""{with_views(SEQS_SQL)}, ref AS (SELECT seq FROM seqs WHERE source = '{views.REFERENCE_RUN}' AND seq <> ''), width AS (SELECT min(length(seq)) AS n FROM ref),
 sets AS (SELECT DISTINCT i, substr(seq, i, 1) AS x FROM ref, width, unnest(range(1, n + 1)) AS u(i)),
 sim(a, b, v) AS (VALUES {SIM_SQL}), last AS (SELECT a AS x, max(v) AS v FROM sim JOIN sets ON b = x AND i = (SELECT n FROM width) GROUP BY a),
 one AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS i, unnest({CHARS}) AS x FROM seqs WHERE seq <> ''),
 hits AS (SELECT doc_id, count(s.i) AS hits, sum(CASE WHEN one.i > (SELECT n FROM width) THEN v ELSE 0 END) AS extra FROM one LEFT JOIN sets s ON s.i = one.i AND s.x = one.x LEFT JOIN last ON last.x = one.x GROUP BY doc_id),
 conserved AS (SELECT seqs.*, CASE WHEN seq = '' THEN 0.5 WHEN length(seq) <= n THEN hits / length(seq) ELSE (hits + 0.5 * extra) / length(seq) END::DOUBLE AS conserv FROM seqs CROSS JOIN width LEFT JOIN hits USING (doc_id))"""


@query("score_conservation", f"{CONSERV_CTE} SELECT doc_id, round(conserv, 10) AS conserv FROM conserved")
def score_conservation(spark, d):
    s = views.seqs(spark, d)
    return r6(design.conservation(s, s.where(F.col("source") == views.REFERENCE_RUN)).select("doc_id", "conserv"))


SCORED_CTE = f"""{CONSERV_CTE}, scored AS (SELECT doc_id, source, seq, {FOLD} AS fold, {ASSEMBLY} AS assembly, conserv, {NOVELTY} AS novelty, {SAFETY} AS toxic FROM (SELECT *, {CHARS} AS c FROM conserved)),
 overall AS (SELECT doc_id, source, seq, CASE WHEN seq = '' THEN 0.5 ELSE fold END::DOUBLE AS fold, CASE WHEN seq = '' THEN 0.5 ELSE assembly END::DOUBLE AS assembly, conserv, CASE WHEN seq = '' THEN 0.5 ELSE novelty END::DOUBLE AS novelty, CASE WHEN seq = '' THEN 0.5 ELSE toxic END::DOUBLE AS toxic,
 round(CASE WHEN seq = '' THEN 0.5 ELSE 0.3 * fold + 0.3 * assembly + 0.15 * conserv + 0.15 * novelty + 0.1 * toxic END::DOUBLE, 10) AS overall FROM scored)"""


def scored(spark, d) -> DataFrame:
    s = views.seqs(spark, d)
    return design.score(s, s.where(F.col("source") == views.REFERENCE_RUN))


@query("score_overall", f"{SCORED_CTE} SELECT doc_id, round(fold, 10) AS fold, round(assembly, 10) AS assembly, round(conserv, 10) AS conserv, round(novelty, 10) AS novelty, round(toxic, 10) AS toxic, overall FROM overall")
def score_overall(spark, d):
    return r6(scored(spark, d).select("doc_id", "fold", "assembly", "conserv", "novelty", "toxic", "overall"))


EXPLAIN_SQL = f"""{SCORED_CTE} SELECT doc_id, array_to_string(list_filter([
 CASE WHEN fold > 0.9 THEN 'stable_fold' END, CASE WHEN toxic > 0.85 THEN 'safe' END, CASE WHEN novelty > 0.7 THEN 'novel' END, CASE WHEN {H} > 0.35 AND {H} < 0.55 THEN 'ideal_hydrophobicity' END,
 CASE WHEN {rat(R.HELIX)} > 0.5 THEN 'helical' END, CASE WHEN {SOL} > 0.7 THEN 'soluble' END], lambda x: x IS NOT NULL), '|') AS strengths,
 array_to_string(list_filter([CASE WHEN fold < 0.7 THEN 'weak_fold' END, CASE WHEN toxic < 0.6 THEN 'unsafe' END, CASE WHEN trunc({CHARGE}) = 0 THEN 'no_net_charge' END,
 CASE WHEN {DISORDER} > 0.5 THEN 'disordered' END, CASE WHEN length(seq) < 50 OR length(seq) > 200 THEN 'unusual_length' END], lambda x: x IS NOT NULL), '|') AS risks,
 array_to_string(CASE WHEN fold < 0.8 OR conserv < 0.5 OR NOT regexp_matches(seq, '{R.MOTIFS['repeat_variant']}') THEN list_filter([CASE WHEN fold < 0.8 THEN 'verify_structure' END, CASE WHEN conserv < 0.5 THEN 'check_core_residues' END,
 CASE WHEN NOT regexp_matches(seq, '{R.MOTIFS['repeat_variant']}') THEN 'missing_repeat_unit' END], lambda x: x IS NOT NULL) ELSE ['test_first'] END, '|') AS recommendations,
 CASE WHEN conserv > 0.8 THEN 'high' WHEN conserv > 0.5 THEN 'medium' ELSE 'low' END AS conservation FROM overall WHERE seq <> ''"""


@query("explain_candidates", EXPLAIN_SQL)
def explain_candidates(spark, d):
    return design.explain(scored(spark, d).where("seq <> ''")).select("doc_id", "strengths", "risks", "recommendations", "conservation")


@query("find_motifs")
def find_motifs(spark, d):
    return ops.find_motifs(views.seqs(spark, d), "doc_id", "seq", R.MOTIFS)


def _motif_sql() -> str:
    parts = [f"SELECT source, '{k}' AS motif, len(regexp_extract_all(seq, '{p}')) AS n FROM seqs" for k, p in R.MOTIFS.items()]
    return f"{with_views(SEQS_SQL)}, m AS ({' UNION ALL '.join(parts)}) SELECT source, motif, sum(n)::BIGINT AS n_hits, count(*) FILTER (n > 0) AS n_sequences FROM m GROUP BY source, motif"


@query("motif_counts", _motif_sql())
def motif_counts(spark, d):
    return ops.motif_counts(views.seqs(spark, d), "source", "seq", R.MOTIFS)


PAD_SQL = f"""{with_views(SEQS_SQL)}, b AS (SELECT doc_id, lang, {TOKENS} AS ids, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS batch FROM seqs),
 w AS (SELECT *, max(len(ids)) OVER (PARTITION BY lang, batch) AS width FROM b)
 SELECT doc_id, batch::INTEGER AS batch, width::INTEGER AS width, len(ids)::INTEGER AS n_real, md5(array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda x: 0)), ' ')) AS padded_md5 FROM w"""


@query("pad_batches", PAD_SQL)
def pad_batches(spark, d):
    rows = views.seqs(spark, d).select("doc_id", "lang", R.token_ids(F.col("seq")).alias("ids"))
    padded = ops.pad_batches(rows, "ids", "lang", "doc_id", 16)
    return padded.select("doc_id", "batch", "width", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_real"), F.md5(F.array_join(F.col("padded").cast("array<string>"), " ").cast("binary")).alias("padded_md5"))
