"""Alignment, cluster, evaluation, embedding, design and generator jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from bioloom.functions import residues as R
from bioloom.operators import align, cluster, design, embed, evaluate, generate, msa, neighbours, records
from bioloom.plans import views
from bioloom.plans.features import CHARS, SCORED_CTE, cnt, r6, rat, scored
from bioloom.plans.views import RAW_SQL, REFERENCE_RUN, SEQS_SQL, SHORT_REFERENCE, SHORT_SQL, split_sql, with_views
from bioloom.session import shared_dir, stored, table
from bioloom.sources import sequences

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
A = R.AMINO


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# --- alignments in columns: languages as groups, Q and H as gaps -------------------------------------------------

LONG = f"{with_views(SEQS_SQL)}, m AS (SELECT lang AS grp, doc_id AS key, unnest(range(1, length(seq) + 1)) AS pos, unnest({CHARS}) AS aa FROM seqs WHERE seq <> ''), ml AS (SELECT * FROM m WHERE aa NOT IN ('Q', 'H')), c AS (SELECT grp, pos, aa, count(*) AS n, min(key) AS first FROM ml GROUP BY ALL)"
STATS = f"{LONG}, rows AS (SELECT lang AS grp, count(*) AS n_rows FROM seqs GROUP BY lang), st AS (SELECT grp, pos, arg_max(aa, n::BIGINT * 1000000000 - first) AS consensus, sum(n)::BIGINT AS n_residues, round(sum(n) / any_value(n_rows), 10) AS coverage FROM c JOIN rows USING (grp) GROUP BY grp, pos)"
METRICS = f"""{STATS}, w AS (SELECT grp, max(pos) AS width FROM st GROUP BY grp), per AS (SELECT ml.grp, key, count(*) AS length, count(*) FILTER (aa = consensus) AS hits, min(ml.pos) AS lo, max(ml.pos) AS hi FROM ml JOIN st ON st.grp = ml.grp AND st.pos = ml.pos GROUP BY ml.grp, key),
 rm AS (SELECT grp, key, length, round(1 - length / width, 10) AS gap_fraction, round(hits / length, 6) AS identity, lo - 1 AS leading, hi - lo + 1 - length AS internal, width - hi AS trailing FROM per JOIN w USING (grp)),
 mt AS (SELECT *, array_to_string(list_filter([CASE WHEN identity < 0.75 THEN 'low_identity' END, CASE WHEN length NOT BETWEEN 50 AND 100 THEN 'length' END], lambda x: x IS NOT NULL), ';') AS outlier FROM rm)"""


def aligned(spark, d):
    return views.seqs(spark, d).withColumn("aligned", F.translate("seq", "QH", "--"))


def residues(spark, d):
    return msa.residue_counts(aligned(spark, d), "lang", "doc_id", "aligned")


def stats(spark, d):
    rows = views.seqs(spark, d).groupBy(F.col("lang").alias("grp")).agg(F.count(F.lit(1)).alias("n_rows"))
    return msa.column_stats(residues(spark, d), rows)


@query("msa_column_stats", f"{STATS} SELECT * FROM st")
def msa_column_stats(spark, d):
    return r6(stats(spark, d))


def metrics(spark, d, columns=None):
    columns = stored(stats(spark, d), "columns") if columns is None else columns
    return msa.row_metrics(aligned(spark, d), "lang", "doc_id", "aligned", columns)


@query("msa_row_metrics", f"{METRICS} SELECT * FROM mt")
def msa_row_metrics(spark, d):
    return r6(metrics(spark, d))


@query("msa_summary", f"{METRICS} SELECT a.grp, n90, n50, lo, mid, hi, n_outliers FROM (SELECT grp, count(*) FILTER (coverage >= 0.9) AS n90, count(*) FILTER (coverage >= 0.5) AS n50 FROM st GROUP BY grp) a JOIN (SELECT grp, min(identity) AS lo, quantile_cont(identity, 0.5) AS mid, max(identity) AS hi, count(*) FILTER (outlier <> '') AS n_outliers FROM mt GROUP BY grp) b USING (grp)")
def msa_summary(spark, d):
    counted = stored(stats(spark, d), "columns")
    columns = counted.groupBy("grp").agg(F.count_if(F.col("coverage") >= 0.9).alias("n90"), F.count_if(F.col("coverage") >= 0.5).alias("n50"))
    found = stored(metrics(spark, d, counted), "metrics")
    rows = found.groupBy("grp").agg(F.min("identity").alias("lo"), F.max("identity").alias("hi"), F.count_if(F.col("outlier") != "").alias("n_outliers"))
    return columns.join(rows, "grp").join(records.grouped_quantiles(found, "grp", "identity", {"mid": 0.5}), "grp")


@query("truncate_msa", f"{with_views(SEQS_SQL)} SELECT doc_id, n::INTEGER AS width, substr(seq, 1, n) AS cut FROM (SELECT *, min(length(seq)) OVER (PARTITION BY lang) AS n FROM seqs)")
def truncate_msa(spark, d):
    return msa.truncated(views.seqs(spark, d), "lang", "seq").select("doc_id", "width", "cut")


@query("column_frequencies", f"{LONG} SELECT grp, pos, {', '.join(f"round(coalesce(sum(n) FILTER (aa = '{a}'), 0) / sum(n), 10) AS f_{a}" for a in A)} FROM c GROUP BY grp, pos")
def column_frequencies(spark, d):
    share = lambda a: (F.sum(F.when(F.col("aa") == a, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"f_{a}")
    return r6(residues(spark, d).groupBy("grp", "pos").agg(*[share(a) for a in A]))


def share_sql(alphabet: str) -> str:
    return f"(coalesce(sum(n) FILTER (strpos('{alphabet}', aa) > 0), 0) / sum(n))"


HYDRO_SQL = "CASE aa " + " ".join(f"WHEN '{a}' THEN {v}::DOUBLE" for a, v in R.HYDROPATHY.items()) + " END"
P = list(R.PROPERTIES)
BEST = f"greatest({', '.join(f'p_{k}' for k in P)})"
DOMINANT = "CASE " + " ".join(f"WHEN p_{k} = {BEST} THEN '{k}'" for k in P) + " END"
ENTROPY = f"""{LONG}, sh AS (SELECT *, n / sum(n) OVER (PARTITION BY grp, pos) AS p FROM c),
 en AS (SELECT grp, pos, round(sum(-p * log2(p)), 10) AS h, arg_max(aa, n::BIGINT * 1000000000 - first) AS consensus, max(p) AS top_share, count(*) AS n_distinct, stddev_pop({HYDRO_SQL}) AS spread, {share_sql('KRHDE')} AS charged, {', '.join(f'{share_sql(a)} AS p_{k}' for k, a in R.PROPERTIES.items())} FROM sh GROUP BY grp, pos),
 pe AS (SELECT grp, pos, consensus, h AS entropy, top_share, CASE WHEN {BEST} > 0.7 THEN 'strong_' || {DOMINANT} WHEN {BEST} > 0.4 THEN 'mixed_' || {DOMINANT} ELSE 'balanced' END AS property, h < 0.5 AND top_share > 0.9 AS conserved, h > 2.5 AS hypervariable,
  h > 1.0 AND h < 2.5 AND ((n_distinct > 1 AND spread < 1.5) OR charged > 0.8 OR charged < 0.2) AS novel FROM en)"""


def entropy(spark, d):
    return msa.position_entropy(residues(spark, d))


@query("position_entropy", f"{ENTROPY} SELECT grp, pos, consensus, round(entropy, 8) + 0.0 AS entropy, round(top_share, 10) AS top_share, property, conserved, hypervariable, novel FROM pe")
def position_entropy(spark, d):
    return r6(entropy(spark, d).withColumn("entropy", F.round("entropy", 8) + 0.0))


def blocks_sql(least: int) -> str:
    return f"""{ENTROPY}, k AS (SELECT grp, pos, CASE WHEN conserved THEN 'strict_conserved' WHEN novel THEN 'functional_constrained' ELSE '' END AS kind FROM pe),
 f AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER w, '?') <> kind THEN 1 ELSE 0 END AS fresh, lead(pos) OVER w AS after, count(*) OVER (PARTITION BY grp) AS n FROM k WINDOW w AS (PARTITION BY grp ORDER BY pos)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY pos) AS run FROM f), b AS (SELECT grp, run, kind, min(pos) - 1 AS start, coalesce(arg_max(coalesce(after, -1), pos), -1) AS after, any_value(n) AS n FROM r GROUP BY grp, run, kind),
 e AS (SELECT grp, kind, start, CASE WHEN after = -1 THEN n ELSE after - 1 END AS stop FROM b)
 SELECT grp, kind, start::BIGINT AS start, (stop - 1)::BIGINT AS "end" FROM e WHERE kind <> '' AND stop - start >= {least}"""


@query("conserved_blocks", blocks_sql(5))
def conserved_blocks(spark, d):
    found = msa.conserved_blocks(stored(entropy(spark, d), "entropy"), 5)
    return found.select("grp", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


TENTHS = "CASE aa " + " ".join(f"WHEN '{a}' THEN {round(10 * v)}" for a, v in R.HYDROPATHY.items()) + " ELSE 0 END"


def disordered_sql(rows: str, key: str) -> str:
    """Tables that make ``pick(key, i)``: windows of fifteen, taken from the left, of the sequences in ``rows(key, seq)``."""
    return f"""ch AS (SELECT {key}, unnest(range(1, length(seq) + 1)) AS pos, unnest({CHARS}) AS aa FROM {rows} WHERE seq <> ''), su AS (SELECT {key}, pos, sum({TENTHS}) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS v, max(pos) OVER (PARTITION BY {key}) AS len FROM ch),
 low AS (SELECT {key}, pos - 15 AS i FROM su WHERE pos >= 15 AND pos < len AND v < -150), nx AS (SELECT {key}, i, min(i) OVER (PARTITION BY {key} ORDER BY i RANGE BETWEEN 16 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM low),
 pick AS (SELECT {key}, min(i) AS i FROM low GROUP BY {key} UNION ALL SELECT nx.{key}, nx.after FROM pick JOIN nx ON nx.{key} = pick.{key} AND nx.i = pick.i WHERE nx.after IS NOT NULL)"""


REGIONS_SQL = f"""{blocks_sql(4).replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT grp, kind, start::BIGINT", " , bl AS (SELECT grp, kind, start::BIGINT")}), ex AS (SELECT lang AS grp, arg_min(seq, doc_id) AS seq FROM seqs WHERE seq <> '' GROUP BY lang),
 s AS (SELECT *, lag(property) OVER (PARTITION BY grp ORDER BY pos) AS before FROM pe), {disordered_sql('ex', 'grp')}
 SELECT bl.grp, 'block' AS kind, start + 1 AS start, "end" + 1 AS "end", kind AS note, substr(seq, start + 1, "end" - start + 1) AS sequence FROM bl JOIN ex USING (grp)
 UNION ALL SELECT grp, 'adaptive', pos, pos, consensus, NULL FROM pe WHERE entropy > 1.5 AND entropy < 3.0 AND top_share > 0.5 AND top_share < 0.9
 UNION ALL SELECT grp, 'switch', pos, pos, before || ' -> ' || property, NULL FROM s WHERE before <> property AND starts_with(property, 'strong') AND entropy > 1.0
 UNION ALL SELECT pick.grp, 'disordered', i + 1, i + 15, NULL, substr(seq, i::BIGINT + 1, 15) FROM pick JOIN ex USING (grp)"""


@query("functional_regions", REGIONS_SQL)
def functional_regions(spark, d):
    examples = views.seqs(spark, d).where("seq != ''").groupBy(F.col("lang").alias("grp")).agg(F.min_by("seq", "doc_id").alias("example"))
    return msa.functional_regions(stored(entropy(spark, d), "entropy"), examples)


@query("disordered_windows", f"WITH RECURSIVE {SHORT_SQL}, {disordered_sql('short', 'page_id')}, li AS (SELECT page_id, list(i::INTEGER ORDER BY i) AS starts FROM pick GROUP BY page_id) SELECT page_id, coalesce(starts, []) AS starts FROM short LEFT JOIN li USING (page_id)")
def disordered_windows(spark, d):
    return views.short(spark, d).select("page_id", msa.low_hydropathy_windows(F.col("seq"), 15).alias("starts"))


CHECK_CHARGE = "CASE WHEN aa IN ('K', 'R', 'H') THEN 1.0 WHEN aa IN ('D', 'E') THEN -1.0 ELSE 0.0 END"


@query("window_position_profile", f"{with_views(SEQS_SQL)}, m AS (SELECT unnest(range(51, least(90, length(seq)) + 1)) AS pos, unnest(string_split(substr(seq, 51, 40), '')) AS aa FROM seqs WHERE length(seq) > 50), c AS (SELECT pos, aa, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY pos) AS p FROM c) SELECT pos, round(sum(n * {HYDRO_SQL}) / sum(n), 8) AS hydropathy, round(sum(n * {CHECK_CHARGE}) / sum(n), 8) AS charge, round(1 - sum(-p * log2(p)) / log2(20), 8) AS conservation FROM p GROUP BY pos")
def window_position_profile(spark, d):
    return evaluate.window_profile(views.seqs(spark, d), "seq", 50, 40)


# --- evaluation of runs -----------------------------------------------------------------------------------------

COMP = ", ".join(f"sum({cnt(a)}) / sum(length(seq)) AS p_{a}" for a in A)
L1 = " + ".join(f"abs(p.p_{a} - q.p_{a})" for a in A)
#: The second run that counts as real, beside the training one, and a run that was asked for and has no sequences.
HELD_OUT_RUN, MISSING_RUN = "src1", "src_none"


def run_sql(rows: str, key: str, run: str, train: str, real: str, extra: str = "") -> str:
    """Tables that make ``er``, a row a run, of ``rows(run, key, seq)`` and ``hits(key, hit)``; ``real`` is a condition on runs."""
    return f"""t AS (SELECT min(length(seq)) AS lo, max(length(seq)) AS hi FROM {rows} WHERE {run} = '{train}'), g AS (SELECT {rows}.*, hit FROM {rows} LEFT JOIN hits USING ({key}) WHERE {run} <> '{train}' {extra}),
 dup AS (SELECT {run}, max(n) AS m FROM (SELECT {run}, seq, count(*) AS n FROM g GROUP BY ALL) GROUP BY {run}), q AS (SELECT {COMP} FROM {rows} WHERE {run} = '{train}'), p AS (SELECT {run} AS of, {COMP} FROM g GROUP BY {run}),
 ag AS (SELECT g.{run}, count(*) AS n_generated, round(avg((seq <> '' AND regexp_full_match(seq, '[{A}]*'))::INTEGER), 8) AS legal_char_rate, round(avg((length(seq) BETWEEN lo AND hi)::INTEGER), 8) AS length_in_train_range_rate, round(avg(length(seq)), 8) AS mean_length,
 round(avg((seq IN (SELECT seq FROM {rows} WHERE {run} = '{train}'))::INTEGER), 8) AS exact_copy_train_rate, round(avg((seq IN (SELECT seq FROM {rows} WHERE {run} = '{train}' OR {real}))::INTEGER), 8) AS exact_copy_any_real_rate,
 round(count(DISTINCT seq) / count(*), 8) AS unique_ratio, round(any_value(m) / count(*), 8) AS max_duplicate_fraction, round(avg(hit::INTEGER), 8) AS family_profile_hit_rate FROM g CROSS JOIN t JOIN dup ON dup.{run} = g.{run} GROUP BY g.{run}),
 er AS (SELECT ag.*, round({L1}, 10) AS aa_composition_l1_distance, lo AS train_length_min, hi AS train_length_max, 'run' AS family_profile_status FROM ag JOIN p ON p.of = ag.{run} CROSS JOIN q CROSS JOIN t)"""


RUN_FIELDS = ["n_generated", "legal_char_rate", "length_in_train_range_rate", "mean_length", "exact_copy_train_rate", "exact_copy_any_real_rate", "unique_ratio", "max_duplicate_fraction", "family_profile_hit_rate", "aa_composition_l1_distance", "train_length_min", "train_length_max", "family_profile_status"]
RUN_SQL = f"""{with_views(RAW_SQL)}, hits AS (SELECT doc_id, quality = 1 AS hit FROM labels), {run_sql('raw_seqs', 'doc_id', 'source', REFERENCE_RUN, f"source = '{HELD_OUT_RUN}'")}
 SELECT source, {', '.join(RUN_FIELDS)} FROM er UNION ALL SELECT '{MISSING_RUN}', 0, {', '.join('NULL' for _ in range(9))}, lo, hi, 'run' FROM t"""


def profile_hits(spark, d, rows, column: str):
    """Answers of a profile search over labelled rows: a table of hits is written as the search writes it, and read by its reader."""
    lines = F.concat_ws(" ", F.col(column).cast("string"), F.lit("- family PF -"), F.lit("1e-20 80.5 0.1"))
    path = f"{shared_dir(spark)}/hits-{uuid.uuid4().hex}"
    rows.where("hit").select(lines.alias("value")).unionByName(spark.createDataFrame([("# target name",), ("",)], "value string")).write.text(path)
    found = sequences.read_profile_hits(spark, path).select(F.col("target").cast("long").alias("found")).distinct()
    return rows.join(found, F.col(column) == F.col("found"), "left").select(column, F.col("found").isNotNull().alias("hit"))


@query("evaluate_run", RUN_SQL)
def evaluate_run(spark, d):
    rows = views.raw_seqs(spark, d)
    labels = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("hit"))
    train, real = rows.where(F.col("source") == REFERENCE_RUN), rows.where(F.col("source").isin(REFERENCE_RUN, HELD_OUT_RUN))
    generated = rows.where(F.col("source") != REFERENCE_RUN)
    runs = generated.select("source").unionByName(spark.createDataFrame([(MISSING_RUN,)], "source string"))
    found = evaluate.evaluate_run(generated, train, "source", "seq", real, runs, profile_hits(spark, d, labels, "doc_id"), "doc_id")
    return found.select("source", *RUN_FIELDS)


@query("aa_composition_l1", f"{with_views(SEQS_SQL)}, p AS (SELECT source, {COMP} FROM seqs GROUP BY source), q AS (SELECT * FROM p WHERE source = '{REFERENCE_RUN}') SELECT p.source, round({' + '.join(f'abs(p.p_{a} - q.p_{a})' for a in A)}, 10) AS l1 FROM p, q WHERE p.source <> q.source")
def aa_composition_l1(spark, d):
    rows = views.seqs(spark, d)
    return evaluate.composition_l1(rows.where(F.col("source") != REFERENCE_RUN), rows.where(F.col("source") == REFERENCE_RUN), "source", "seq")


ZS = " UNION ALL ".join(f"SELECT source, '{a}' AS aa, p_{a} AS f FROM p" for a in A)


@query("composition_zscore", f"{with_views(SEQS_SQL)}, p AS (SELECT source, {COMP} FROM seqs GROUP BY source), l AS ({ZS}) SELECT source, aa, round(f, 10) AS f, round((f - avg(f) OVER w) / nullif(stddev_pop(f) OVER w, 0), 8) AS z, abs((f - avg(f) OVER w) / nullif(stddev_pop(f) OVER w, 0)) > 2 AS flagged FROM l WINDOW w AS (PARTITION BY source)")
def composition_zscore(spark, d):
    return evaluate.composition_zscore(views.seqs(spark, d), "source", "seq")


@query("model_comparison", "WITH r AS (SELECT d.source AS model, count(*) AS n, count(quality) AS n_scored, avg(quality) AS quality_rate, avg(n_chars) AS mean_chars, count(*) FILTER (n_chars = 91) AS n_91, count(*) FILTER (toxic = 1) AS n_bad FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source) SELECT model, n, n_scored, round(quality_rate, 8) AS quality_rate, round(mean_chars, 6) AS mean_chars, n_91, n_bad FROM r")
def model_comparison(spark, d):
    rows = views.docs(spark, d)
    return rows.groupBy(F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_scored"), F.round(F.avg("quality"), 8).alias("quality_rate"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("n_chars") == 91).alias("n_91"), F.count_if(F.col("toxic") == 1).alias("n_bad"))


@query("seed_stability", "WITH r AS (SELECT source AS model, lang AS seed, avg(n_chars) AS chars, count(*) AS n FROM documents GROUP BY ALL) SELECT model, round(avg(chars), 6) AS mean_chars, round(max(chars) - min(chars), 6) AS range_chars, min(n) AS least_n, max(n) AS most_n FROM r GROUP BY model")
def seed_stability(spark, d):
    runs = table(spark, d, "documents").groupBy(F.col("source").alias("model"), F.col("lang").alias("seed")).agg(F.avg("n_chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy("model").agg(F.round(F.avg("chars"), 6).alias("mean_chars"), F.round(F.max("chars") - F.min("chars"), 6).alias("range_chars"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))


PARETO_RUNS = "r AS (SELECT source, avg(quality) AS fidelity, 1 - avg(toxic) AS novelty, count(DISTINCT text) / count(*) AS diversity FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source), s AS (SELECT * FROM r WHERE fidelity >= 0.5)"


@query("pareto_front", f"WITH {PARETO_RUNS} SELECT source, round(fidelity, 8) AS fidelity, round(novelty, 8) AS novelty, round(diversity, 8) AS diversity FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.fidelity >= s.fidelity AND o.novelty >= s.novelty AND o.diversity >= s.diversity AND (o.fidelity > s.fidelity OR o.novelty > s.novelty OR o.diversity > s.diversity))")
def pareto_front(spark, d):
    runs = views.docs(spark, d).groupBy("source").agg(F.avg("quality").alias("fidelity"), (1 - F.avg("toxic")).alias("novelty"), (F.count_distinct("text") / F.count(F.lit(1))).alias("diversity"))
    front = evaluate.pareto_front(runs.where("fidelity >= 0.5"), ["fidelity", "novelty", "diversity"])
    return front.select("source", *[F.round(c, 8).alias(c) for c in ("fidelity", "novelty", "diversity")])


@query("model_score_stats", f"{SCORED_CTE} SELECT source, count(*) AS n, round(avg(overall), 8) AS mean, max(overall) AS best, min(overall) AS worst, round(stddev_samp(overall), 8) AS std, arg_max(doc_id, overall * 1e9 - doc_id) AS best_id FROM overall GROUP BY source")
def model_score_stats(spark, d):
    return scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 8).alias("mean"), F.max("overall").alias("best"), F.min("overall").alias("worst"), F.round(F.stddev("overall"), 8).alias("std"), F.max_by("doc_id", F.struct("overall", -F.col("doc_id"))).alias("best_id"))


FUNNEL = ["length(seq) >= 40", "length(seq) <= 3000", f"{rat(R.HYDROPHOBIC)} <= 0.6", "fold >= 0.5", "toxic >= 0.6"]


@query("filter_funnel", f"{SCORED_CTE} SELECT source, {', '.join(f'count(*) FILTER ({" AND ".join(FUNNEL[: i + 1])}) AS step_{i + 1}' for i in range(len(FUNNEL)))} FROM overall GROUP BY source")
def filter_funnel(spark, d):
    n = F.length("seq")
    steps = [n >= 40, n <= 3000, R.ratio(F.col("seq"), R.HYDROPHOBIC) <= 0.6, F.col("fold") >= 0.5, F.col("toxic") >= 0.6]
    return evaluate.funnel(scored(spark, d), "source", steps)


@query("top_candidates", f"{SCORED_CTE}, r AS (SELECT source, doc_id, overall, row_number() OVER (PARTITION BY source ORDER BY overall DESC, doc_id)::INTEGER AS place FROM overall) SELECT * FROM r WHERE place <= 10")
def top_candidates(spark, d):
    return evaluate.top_per_group(scored(spark, d).select("source", "doc_id", "overall"), "source", "overall", "doc_id", 10)


@query("top_overall", f"{SCORED_CTE} SELECT doc_id, source, overall FROM overall ORDER BY overall DESC, doc_id LIMIT 20")
def top_overall(spark, d):
    return scored(spark, d).select("doc_id", "source", "overall").orderBy(F.col("overall").desc(), "doc_id").limit(20)


@query("recommended_set", f"{SCORED_CTE} SELECT doc_id, overall FROM overall WHERE {' AND '.join(FUNNEL)}")
def recommended_set(spark, d):
    """Candidates that pass all five filters of the funnel."""
    n = F.length("seq")
    passed = (n >= 40) & (n <= 3000) & (R.ratio(F.col("seq"), R.HYDROPHOBIC) <= 0.6) & (F.col("fold") >= 0.5) & (F.col("toxic") >= 0.6)
    # Filtered only when stored: a filter on scores that are still expressions would work them out on its own.
    return stored(scored(spark, d).select("doc_id", "overall", passed.alias("passed")), "scored").where("passed").select("doc_id", "overall")


@query("length_counts", f"{with_views(SEQS_SQL)} SELECT length(seq)::INTEGER AS length, count(*) AS n FROM seqs GROUP BY 1")
def length_counts(spark, d):
    return views.seqs(spark, d).groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("select_diverse")
def select_diverse(spark, d):
    rows = stored(scored(spark, d).select("doc_id", "seq", "overall"), "scored")
    return spark.createDataFrame(design.select_diverse(rows, "doc_id", 10, 0.3, 0.6), "doc_id long, overall double, rank int")


LOGO_SQL = f"""{SCORED_CTE}, t AS (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY overall DESC, doc_id) AS place FROM overall WHERE seq <> ''), b AS (SELECT *, least(50, min(length(seq)) OVER (PARTITION BY source)) AS w FROM t WHERE place <= 20),
 m AS (SELECT source, unnest(range(1, w + 1)) AS pos, unnest(string_split(substr(seq, 1, w), '')) AS aa FROM b), c AS (SELECT source, pos, aa, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY source, pos) AS p FROM c),
 i AS (SELECT source, pos, greatest(0, log2(20) - sum(-p * log2(p))) AS ic FROM p GROUP BY source, pos) SELECT source, pos, aa, round(ic, 8) AS ic, round(p * ic, 8) AS height FROM p JOIN i USING (source, pos)"""


@query("logo_information", LOGO_SQL)
def logo_information(spark, d):
    # Ranked are heads as long as the logo, which are as short as their sequences are; no whole sequence is stored or sorted.
    heads = stored(scored(spark, d).select("source", "doc_id", F.left("seq", F.lit(50)).alias("seq"), "overall"), "scored")
    top = evaluate.top_per_group(heads.where("seq != ''"), "source", "overall", "doc_id", 20)
    return evaluate.logo(top, "source", "seq", 50)


# --- pairs of short sequences --------------------------------------------------------------------------------------


def split_short(spark, d):
    rows = views.short(spark, d)
    return rows.where(F.col("run") != SHORT_REFERENCE), rows.where(F.col("run") == SHORT_REFERENCE)


@query("global_identity")
def global_identity(spark, d):
    rows = views.short(spark, d)
    other = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("seq").alias("other"))
    return r6(align.global_identity(rows.join(other, "page_id").select("page_id", "seq", "other"), "seq", "other").drop("seq", "other"))


@query("nearest_reference")
def nearest_reference(spark, d):
    made, ref = split_short(spark, d)
    return r6(align.nearest_reference(made, ref, "page_id", "seq"))


@query("run_identity")
def run_identity(spark, d):
    made, ref = split_short(spark, d)
    return r6(evaluate.run_identity(made, ref, "run", "page_id", "seq"))


@query("max_identity_novelty")
def max_identity_novelty(spark, d):
    made, ref = split_short(spark, d)
    best = align.nearest_reference(made, ref, "page_id", "seq")
    return best.select("page_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("identity"))), 3).alias("novelty"))


def short_pairs(spark, d):
    return stored(align.near_duplicates(views.short(spark, d), "page_id", "seq", 0.95, 0.8), "pairs")


@query("near_duplicates")
def near_duplicates(spark, d):
    return r6(short_pairs(spark, d))


POS_SQL = f"""{with_views(SHORT_SQL)}, g AS (SELECT * FROM short WHERE run <> '{SHORT_REFERENCE}'), r AS (SELECT page_id AS ref_id, seq AS ref FROM short WHERE run = '{SHORT_REFERENCE}'),
 x AS (SELECT page_id, ref_id, CASE WHEN least(length(seq), length(ref)) > 0 THEN len(list_filter(range(1, least(length(seq), length(ref)) + 1), lambda i: seq[i] = ref[i])) / least(length(seq), length(ref)) ELSE 0.0 END AS v FROM g, r)
 SELECT page_id, round(max(v), 10) AS identity, CASE WHEN max(v) > 0 THEN arg_max(ref_id, v * 1e9 - ref_id) END AS reference FROM x GROUP BY page_id"""


@query("positional_identity", POS_SQL)
def positional_identity(spark, d):
    made, ref = split_short(spark, d)
    best = align.nearest_by_place(made, ref, "page_id", "seq")
    return best.select("page_id", F.round("identity", 10).alias("identity"), F.when(F.col("identity") > 0, F.col("reference")).alias("reference"))


@query("pairwise_diversity")
def pairwise_diversity(spark, d):
    return r6(align.pairwise_diversity(views.short(spark, d), "run", "page_id", "seq"))


@query("near_duplicates_seeded")
def near_duplicates_seeded(spark, d):
    return r6(neighbours.seeded_neighbours(views.short(spark, d), "page_id", "seq", 0.95, 0.8))


#: Clusters, splits and leaks go by edit distance: similar are sequences that differ by at most so large a part of the longer one.
SIMILAR, RELATED = 0.95, 0.85
EDIT_SQL = f"""{SHORT_SQL}, nodes AS (SELECT seq AS s, min(page_id) AS k, length(seq) AS n FROM short WHERE seq <> '' GROUP BY seq),
 e AS (SELECT a.k AS query, b.k AS target, levenshtein(a.s, b.s) AS distance, greatest(a.n, b.n) AS longest, least(a.n, b.n) / a.n AS qcov, least(a.n, b.n) / b.n AS tcov FROM nodes a JOIN nodes b ON a.k < b.k),
 pairs AS (SELECT query, target, distance, 1 - distance / longest AS identity, qcov, tcov FROM e WHERE distance <= floor((1 - {RELATED}) * longest + 1e-9))"""
NODE_COMPS_SQL = f"""{EDIT_SQL}, links AS (SELECT query AS a, target AS b FROM e WHERE distance <= floor((1 - {SIMILAR}) * longest + 1e-9)),
 walk AS (SELECT page_id AS node, page_id AS seen FROM short UNION SELECT walk.node, l.b FROM walk JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = walk.seen),
 of AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
 comps AS (SELECT page_id, component FROM short JOIN (SELECT s, k FROM nodes UNION ALL SELECT seq, min(page_id) FROM short WHERE seq = '' GROUP BY seq) x ON x.s = short.seq JOIN of ON of.node = x.k)"""


@query("edit_neighbours", f"WITH {EDIT_SQL} SELECT query, target, distance, round(identity, 10) AS identity, round(qcov, 10) AS qcov, round(tcov, 10) AS tcov FROM pairs")
def edit_neighbours(spark, d):
    return r6(neighbours.edit_neighbours(views.short(spark, d), "page_id", "seq", RELATED))


def similar_pairs(spark, d):
    return stored(neighbours.edit_neighbours(views.short(spark, d), "page_id", "seq", SIMILAR), "pairs")


def short_nodes(spark, d):
    rows = views.short(spark, d)
    return rows.join(rows.groupBy("seq").agg(F.min("page_id").alias("node")), "seq").select("page_id", "seq", "run", "node")


def short_components(spark, d, pairs):
    nodes = short_nodes(spark, d)
    comps = cluster.cluster_components(nodes.select(F.col("node").alias("page_id")), "page_id", pairs).withColumnRenamed("page_id", "node")
    return nodes.join(comps, "node").select("page_id", "component")


@query("cluster_components", f"WITH RECURSIVE {NODE_COMPS_SQL} SELECT page_id, component FROM comps")
def cluster_components(spark, d):
    return short_components(spark, d, similar_pairs(spark, d))


@query("representatives", f"WITH RECURSIVE {NODE_COMPS_SQL}, r AS (SELECT component, page_id, row_number() OVER (PARTITION BY component ORDER BY length(seq) DESC, page_id) AS p, count(*) OVER (PARTITION BY component) AS size FROM comps JOIN short USING (page_id)) SELECT component, page_id AS representative, size FROM r WHERE p = 1")
def representatives(spark, d):
    return cluster.representatives(views.short(spark, d), "page_id", "seq", short_components(spark, d, similar_pairs(spark, d)))


@query("leakfree_split", f"WITH RECURSIVE c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, lang) AS component FROM documents), {split_sql('c')} SELECT component, size, split FROM parts")
def leakfree_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    first = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("component"))
    same = docs["source"].eqNullSafe(first["source"]) & docs["lang"].eqNullSafe(first["lang"])
    return cluster.leakfree_split(docs.join(first, same).select("doc_id", "component"))


@query("leakage_check", f"WITH RECURSIVE {NODE_COMPS_SQL}, {split_sql('comps')}, sp AS (SELECT page_id, split FROM comps JOIN parts USING (component)), x AS (SELECT CASE WHEN least(qcov, tcov) >= 0.8 THEN identity END AS identity FROM pairs JOIN sp a ON a.page_id = query JOIN sp b ON b.page_id = target WHERE a.split <> b.split) SELECT count(*) AS n_cross_pairs, round(max(identity), 10) AS max_identity, count(*) FILTER (identity >= 0.95) AS n_leaks FROM x")
def leakage_check(spark, d):
    comps = stored(short_components(spark, d, similar_pairs(spark, d)), "comps")
    splits = comps.join(cluster.leakfree_split(comps), "component").select("page_id", "split")
    related = neighbours.edit_neighbours(views.short(spark, d), "page_id", "seq", RELATED)
    return r6(cluster.leakage_check(related, splits, "page_id", 0.8, 0.95))


HITS_SQL = f"{with_views(SHORT_SQL)}, h AS (SELECT a.page_id AS query, b.page_id AS target, len(list_filter(range(1, least(length(a.seq), length(b.seq)) + 1), lambda i: a.seq[i] = b.seq[i])) / least(length(a.seq), length(b.seq)) AS identity, least(length(a.seq), length(b.seq)) / length(a.seq) AS qcov, least(length(a.seq), length(b.seq)) / length(b.seq) AS tcov FROM short a JOIN short b ON a.run <> '{SHORT_REFERENCE}' AND b.run = '{SHORT_REFERENCE}' AND a.seq <> '' AND b.seq <> '')"


@query("best_heldout_hit", f"{HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY identity DESC, least(qcov, tcov) DESC, target DESC) AS p FROM h) SELECT query, target, round(identity, 10) AS identity, round(qcov, 10) AS qcov, round(tcov, 10) AS tcov, identity >= 0.8 AND least(qcov, tcov) >= 0.8 AS blocked FROM r WHERE p = 1")
def best_heldout_hit(spark, d):
    made, ref = (x.where("seq != ''") for x in split_short(spark, d))
    best = align.nearest_by_place(made, ref, "page_id", "seq", covered=True, latest=True)
    return r6(cluster.best_hits(best.withColumnsRenamed({"page_id": "query", "reference": "target"})))


SCREEN_SQL = f"""{with_views(SHORT_SQL)}, hits AS (SELECT page_id, length(html) % 10 <> 0 AS hit FROM pages), {run_sql('short', 'page_id', 'run', SHORT_REFERENCE, 'false')},
 v AS (SELECT run, avg((seq <> '' AND regexp_full_match(seq, '[{A}]*') AND length(seq) BETWEEN lo AND hi)::INTEGER) AS valid FROM g CROSS JOIN t GROUP BY run)
 SELECT run, n_generated, family_profile_hit_rate, aa_composition_l1_distance, exact_copy_any_real_rate, unique_ratio, max_duplicate_fraction, round(valid, 10) AS valid_candidate_rate,
 CASE WHEN valid <> 1 THEN 'fail_invalid' WHEN family_profile_hit_rate IS NULL THEN 'unassessed' WHEN family_profile_hit_rate < 0.95 THEN 'fail_profile' ELSE 'pass' END AS fidelity_screen FROM er JOIN v USING (run)"""


def short_hits(spark, d):
    pages = table(spark, d, "pages").select("page_id", (F.length("html") % 10 != 0).alias("hit"))
    return profile_hits(spark, d, pages.where("hit IS NOT NULL"), "page_id")


@query("fidelity_screen", SCREEN_SQL)
def fidelity_screen(spark, d):
    made, ref = split_short(spark, d)
    return r6(evaluate.screened(made, ref, "run", "page_id", "seq", short_hits(spark, d)))


@query("integrated_evaluation")
def integrated_evaluation(spark, d):
    made, ref = split_short(spark, d)
    return r6(evaluate.integrated(made, ref, "run", "page_id", "seq", short_hits(spark, d)))


@query("run_report")
def run_report(spark, d):
    made, ref = split_short(spark, d)
    return r6(evaluate.run_report(made, ref, "run", "page_id", "seq", hits=short_hits(spark, d)))


# --- embeddings: label 0 is the real training set, label 1 held-out real vectors ------------------------------------

DIST = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("l2_normalize", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12), 8)) AS unit FROM embeddings")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(embed.l2_normalize(F.col("embedding")), lambda x: F.round(x, 8)).alias("unit"))


NEAR_SQL = f"n AS (SELECT a.vec_id, any_value(a.label) AS label, min({DIST}) AS distance FROM embeddings a, embeddings b WHERE b.label = 0 GROUP BY a.vec_id)"


def nearest(spark, d):
    rows = table(spark, d, "embeddings")
    return embed.nearest_distance(rows, rows.where("label = 0"), "vec_id", "embedding").drop("computed").join(rows.select("vec_id", "label"), "vec_id")


@query("nearest_embedding_distance", f"WITH {NEAR_SQL} SELECT vec_id, round(CASE WHEN distance < 1e-6 THEN 0 ELSE distance END, 6) AS distance FROM n")
def nearest_embedding_distance(spark, d):
    return nearest(spark, d).select("vec_id", F.round(F.when(F.col("distance") < 1e-6, 0.0).otherwise(F.col("distance")), 6).alias("distance"))


@query("embedding_outliers", f"WITH {NEAR_SQL}, t AS (SELECT quantile_cont(distance, 0.95) AS threshold FROM n WHERE label = 1) SELECT label, count(*) AS n, round(any_value(threshold), 6) AS threshold, round(avg((label <> 0 AND distance > threshold)::INTEGER), 8) AS outlier_rate FROM n, t GROUP BY label")
def embedding_outliers(spark, d):
    return outlier_rates(spark, d)


def outlier_rates(spark, d):
    rows = stored(nearest(spark, d), "distances")
    limit = records.quantiles(rows.where("label = 1"), ["distance"], {"threshold": 0.95}).select("threshold")
    flagged = rows.crossJoin(F.broadcast(limit)).withColumn("out", ((F.col("label") != 0) & (F.col("distance") > F.col("threshold"))).cast("int"))
    return flagged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("threshold"), 6).alias("threshold"), F.round(F.avg("out"), 8).alias("outlier_rate"))


BAND_SQL = f"bw AS (SELECT coalesce(quantile_cont(v, 0.5), 1.0) AS bandwidth FROM (SELECT {DIST} * {DIST} AS v FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = 0 AND b.label = 0) WHERE v > 0)"


def bandwidth(spark, d):
    return embed.median_bandwidth(table(spark, d, "embeddings").where("label = 0"), "vec_id", "embedding")


@query("median_bandwidth", f"WITH {BAND_SQL} SELECT round(bandwidth, 8) AS bandwidth FROM bw")
def median_bandwidth(spark, d):
    return bandwidth(spark, d).withColumn("bandwidth", F.round("bandwidth", 8))


@query("mmd2", f"WITH {BAND_SQL}, k AS (SELECT a.label AS x, b.label AS y, avg(exp(-{DIST} * {DIST} / (2 * bandwidth))) AS m FROM embeddings a, embeddings b, bw WHERE a.label = b.label OR b.label = 0 GROUP BY ALL) SELECT own.x AS label, round(own.m + r.m - 2 * xy.m, 6) + 0.0 AS mmd2 FROM k own JOIN k xy ON xy.x = own.x AND xy.y = 0 JOIN k r ON r.x = 0 AND r.y = 0 WHERE own.x = own.y")
def mmd2(spark, d):
    width = bandwidth(spark, d).first()[0]
    found = embed.mmd2(table(spark, d, "embeddings"), "label", "embedding", 0, width)
    return found.withColumn("mmd2", F.round("mmd2", 6) + 0.0)


@query("mmd_bootstrap")
def mmd_bootstrap(spark, d):
    rows = table(spark, d, "embeddings")
    found = embed.mmd_bootstrap(rows, "label", "embedding", 0, bandwidth(spark, d).first()[0])
    rates = outlier_rates(spark, d).select(F.col("label").alias("of"), "outlier_rate")
    judged = found.join(rates, F.col("label") == F.col("of")).drop("of")
    return r6(judged.withColumn("assessment", embed.assess(F.col("median"), F.col("real_q95"), F.col("outlier_rate"))))


@query("project_pca")
def project_pca(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(embed.l2_normalize(F.col("embedding"))).alias("v"))
    made = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows)
    return made.select("vec_id", vector_to_array("p")[0].alias("x"), vector_to_array("p")[1].alias("y"))


# --- baseline generators -------------------------------------------------------------------------------------------


@query("fit_aa_frequency", f"{with_views(SEQS_SQL)} " + " UNION ALL ".join(f"SELECT '{a}' AS aa, sum({cnt(a)})::BIGINT AS n FROM seqs" for a in A))
def fit_aa_frequency(spark, d):
    return generate.letter_counts(views.seqs(spark, d), "seq")


CUM = f"{with_views(SEQS_SQL)}, k AS (" + " UNION ALL ".join(f"SELECT '{a}' AS aa, sum({cnt(a)})::BIGINT AS n FROM seqs" for a in A) + "), cum AS (SELECT aa, sum(n) OVER (ORDER BY aa) / sum(n) OVER () AS hi, coalesce(sum(n) OVER (ORDER BY aa ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS lo FROM k)"


@query("sample_aa_frequency", f"""{CUM}, ln AS (SELECT length(seq)::BIGINT AS size, count(*) AS n FROM seqs WHERE seq <> '' GROUP BY 1), lc AS (SELECT size, sum(n) OVER (ORDER BY size) / sum(n) OVER () AS hi FROM ln),
 d AS (SELECT i AS idx, (SELECT min(size) FROM lc WHERE hi > (('0x' || substr(md5('42:' || i || ':length'), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0::DOUBLE) AS size FROM range(200) a(i)),
 u AS (SELECT idx, p AS pos, (('0x' || substr(md5('42:' || idx || ':' || p), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM (SELECT idx, unnest(range(0, size)) AS p FROM d)) SELECT idx, string_agg(aa, '' ORDER BY pos) AS seq FROM u JOIN cum ON u.u >= lo AND u.u < hi GROUP BY idx""")
def sample_aa_frequency(spark, d):
    seqs = views.seqs(spark, d)
    return generate.sample_letters(spark, generate.letter_counts(seqs, "seq"), generate.length_counts(seqs, "seq"), 200, 42)


KMER_SQL = f"{with_views(SEQS_SQL)}, p AS (SELECT string_split('^^' || seq || '$', '') AS c FROM seqs), g AS (SELECT unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM p), t AS (SELECT substr(g, 1, 2) AS context, substr(g, 3, 1) AS next, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT '', aa, n FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS aa, sum({cnt(a)})::BIGINT AS n FROM seqs" for a in A) + ") WHERE n > 0) SELECT context, next, n FROM t"


@query("fit_kmer_markov", KMER_SQL)
def fit_kmer_markov(spark, d):
    return generate.kmer_counts(views.seqs(spark, d), "seq", 3)


@query("sample_kmer_markov")
def sample_kmer_markov(spark, d):
    counts = stored(generate.kmer_counts(views.seqs(spark, d), "seq", 3), "kmers")
    return generate.sample_kmers(spark, counts, 200, 60, 3, 42)


# --- parts and regulation --------------------------------------------------------------------------------------------

PARTS_SQL = "parts AS (SELECT p_type, p_brand AS element_id, min(p_name) AS species, round(avg(p_retailprice) / 1000, 6) AS strength FROM part GROUP BY p_type, p_brand), q AS (SELECT *, dense_rank() OVER (ORDER BY p_type) - 1 AS t FROM parts)"
SPACE_SQL = f"WITH {PARTS_SQL}, sp AS (SELECT a.element_id AS promoter, b.element_id AS rbs, c.element_id AS cds, d.element_id AS terminator, a.strength AS x0, b.strength AS x1, c.strength AS x2, d.strength AS x3, a.strength * b.strength AS x4, c.strength * d.strength AS x5, a.strength * c.strength AS x6, (len(list_distinct([a.species, b.species, c.species, d.species])) - 1) * 0.12::DOUBLE AS x7, 1.0::DOUBLE AS x8 FROM q a, q b, q c, q d WHERE a.t = 0 AND b.t = 1 AND c.t = 2 AND d.t = 3)"


def parts(spark, d):
    rows = table(spark, d, "part").groupBy("p_type", F.col("p_brand").alias("element_id")).agg(F.min("p_name").alias("species"), F.round(F.avg("p_retailprice") / 1000, 6).alias("strength"))
    kinds = [r[0] for r in rows.select("p_type").distinct().orderBy("p_type").take(4)]
    names = dict(zip(kinds, ("promoter", "rbs", "cds", "terminator")))
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn("element_type", F.try_element_at(mapping, F.col("p_type"))).where("element_type IS NOT NULL")


@query("design_space", f"{SPACE_SQL} SELECT promoter, rbs, cds, terminator, {', '.join(f'round(x{i}, 8) AS x{i}' for i in range(9))} FROM sp")
def design_space(spark, d):
    space = design.design_space(stored(parts(spark, d), "parts"))
    return space.select("promoter", "rbs", "cds", "terminator", *[F.round(c, 8).alias(c) for c in design.FEATURES])


YSQL = "greatest(0.02, 0.55 * x0 + 0.70 * x1 + 0.52 * x2 + 0.40 * x3 + 0.34 * x4 + 0.26 * x5 - 0.48 * x7)"


@query("ridge_moments", f"{SPACE_SQL} SELECT " + ", ".join(f"round(sum(x{i} * {YSQL}) / count(*), 6) AS xy{i}" for i in range(9)) + " FROM sp")
def ridge_moments(spark, d):
    space = design.design_space(stored(parts(spark, d), "parts")).withColumn("y", design.target_expression())
    return space.agg(*[F.round(F.sum(F.col(c) * F.col("y")) / F.count(F.lit(1)), 6).alias(f"xy{i}") for i, c in enumerate(design.FEATURES)])


@query("ridge_expression")
def ridge_expression(spark, d):
    space = stored(design.design_space(stored(parts(spark, d), "parts")).withColumn("y", design.target_expression()), "space")
    train = F.xxhash64("promoter", "rbs", "cds", "terminator") / F.lit(2.0**64) + 0.5 < 0.8
    coefficients = design.ridge_fit(space.where(train))
    judged = space.withColumn("set", F.when(train, "train").otherwise("test")).withColumn("p", design.ridge_predict(coefficients))
    mean = F.avg("y").over(Window.partitionBy("set"))
    return r6(judged.withColumn("m", mean).groupBy("set").agg(F.count(F.lit(1)).alias("n"), (1 - F.sum((F.col("y") - F.col("p")) ** 2) / F.sum((F.col("y") - F.col("m")) ** 2)).alias("r2")))


EDGES_SQL = "e AS (SELECT s_nationkey AS source, c_nationkey AS target, round(avg(c_acctbal) / 10000, 6) AS weight FROM supplier JOIN customer ON s_suppkey = c_custkey GROUP BY ALL)"
PATHS_SQL = f"WITH RECURSIVE {EDGES_SQL}, p AS (SELECT source, target, [source, target] AS nodes, weight AS strength FROM e WHERE source <> target UNION ALL SELECT p.source, e.target, list_append(nodes, e.target), strength * weight FROM p JOIN e ON p.target = e.source WHERE len(nodes) <= 3 AND NOT list_contains(nodes, e.target)) SELECT source, target, array_to_string(nodes, '>') AS path, round(strength, 8) + 0.0 AS strength FROM p"


@query("regulatory_paths", PATHS_SQL)
def regulatory_paths(spark, d):
    joined = table(spark, d, "supplier").join(table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    edges = joined.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.round(F.avg("c_acctbal") / 10000, 6).alias("weight"))
    found = evaluate.simple_paths(stored(edges, "edges"), 3)
    return found.select("source", "target", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("path"), (F.round("strength", 8) + 0.0).alias("strength"))
