"""Curation and record-database jobs over the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from bioloom.functions import headers, residues as R
from bioloom.operators import cluster, curate, freeze, records
from bioloom.plans import views
from bioloom.plans.features import r6
from bioloom.plans.views import DOCS_SQL, LOWER, RAW_SQL, SEQS_SQL, UPPER, split_sql, with_views
from bioloom.session import numbered, shared_dir, stored, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
A = R.AMINO
#: The invented documents' stand-ins for a family's annotation.
RULES = curate.Rules(lineage=("en", "fr"), explicit="that|que", other="token|secret|key", ambiguous="license|untitled", partial="thing|chose", region="EN", xref="SRC0", min_length=200, max_length=4000)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def found(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, '(?i)(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)')"


def records_view(spark, d):
    up = F.translate("text", LOWER, UPPER)
    wp = F.when(F.col("quality") == 1, "WP_").otherwise("XX_")
    return views.docs(spark, d).select(
        F.col("doc_id").alias("seq_order"), F.concat(wp, "source", F.lit("_"), F.col("n_chars").cast("string")).alias("sequence_id"),
        F.regexp_replace(up, "[^A-Z]", "").alias("sequence"), F.lit("").alias("header"), F.col("quality").isNotNull().alias("has_metadata"),
        F.lit(None).cast("string").alias("meta_sequence"), F.col("source").alias("taxonomy"), F.col("lang").alias("organism"), F.col("text").alias("definition"),
        F.lit("").alias("products"), F.lit("").alias("genes"), F.lit("").alias("comments"), (F.col("toxic") == 1).alias("partial5"), F.lit(False).alias("partial3"),
        (F.col("quality") == 1).alias("complete_by_feature"), F.col("lang").alias("region_names"), F.col("source").alias("cdd_xrefs"), "lang", "source",
    )


PARTIAL = f"({found(RULES.partial)} OR coalesce(toxic = 1, false))"
CLASSIFIED = f"""{with_views(DOCS_SQL)},
 rec AS (SELECT *, regexp_replace(translate(text, '{LOWER}', '{UPPER}'), '[^A-Z]', '', 'g') AS seq, quality IS NOT NULL AS has,
  CASE WHEN quality = 1 THEN 'WP_' ELSE 'XX_' END || source || '_' || n_chars::VARCHAR AS sequence_id FROM docs),
 raw AS (SELECT *, list_filter([CASE WHEN seq = '' THEN 'empty_sequence' END,
  CASE WHEN NOT regexp_full_match(seq, '[{A}]*') THEN 'invalid_amino_acids:' || array_to_string(list_sort(list_distinct(list_filter(string_split(translate(seq, '{A}', ''), ''), lambda x: x <> ''))), '') END,
  CASE WHEN has AND NOT (contains(lower(source || '; ' || lang), 'en') OR contains(lower(source || '; ' || lang), 'fr')) THEN 'outside_lineage' END,
  CASE WHEN has AND {found(RULES.other)} THEN 'annotated_as_other_family_member' END,
  CASE WHEN has AND NOT {found(RULES.other)} AND NOT {found(RULES.explicit)} AND {found(RULES.ambiguous)} THEN 'ambiguous_annotation' END,
  CASE WHEN has AND {PARTIAL} THEN 'partial_fragment_or_incomplete' END], lambda x: x IS NOT NULL) AS ex,
  list_filter([CASE WHEN NOT has THEN 'metadata_not_retrieved' END,
  CASE WHEN has AND NOT {found(RULES.other)} AND NOT {found(RULES.explicit)} AND NOT {found(RULES.ambiguous)} THEN 'identity_not_explicit' END,
  CASE WHEN has AND NOT {PARTIAL} AND NOT coalesce(quality = 1, false) THEN 'full_length_not_confirmed' END,
  CASE WHEN has AND NOT (upper(lang) = 'EN' AND upper(source) = 'SRC0') THEN 'domain_not_confirmed' END,
  CASE WHEN length(seq) NOT BETWEEN 200 AND 4000 THEN 'length_outside_review_range:200-4000' END], lambda x: x IS NOT NULL) AS rv FROM rec),
 cl AS (SELECT doc_id, sequence_id, seq, lang, source, quality, CASE WHEN len(ex) > 0 THEN 'exclude' WHEN len(rv) > 0 THEN 'review' ELSE 'include' END AS decision,
  CASE WHEN len(ex) + len(rv) = 0 THEN ['{curate.PASSES}'] ELSE list_sort(list_distinct(list_concat(ex, rv))) END AS reasons FROM raw)"""
RANK = "CASE decision WHEN 'include' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, CASE WHEN starts_with(sequence_id, 'WP_') THEN 0 ELSE 1 END, doc_id"
RESOLVED = f"""{CLASSIFIED},
 p1 AS (SELECT *, row_number() OVER w > 1 AND seq <> '' AS lost, first_value(sequence_id) OVER w AS best FROM cl WINDOW w AS (PARTITION BY seq ORDER BY {RANK})),
 m1 AS (SELECT doc_id, sequence_id, seq, lang, source, CASE WHEN lost THEN 'exclude' ELSE decision END AS decision, CASE WHEN lost THEN best END AS dup_seq,
  CASE WHEN lost THEN list_sort(list_append(list_filter(reasons, lambda r: r <> '{curate.PASSES}'), '{curate.DUPLICATE_SEQUENCE}')) ELSE reasons END AS reasons FROM p1),
 p2 AS (SELECT *, row_number() OVER w > 1 AS lost, first_value(sequence_id) OVER w AS best FROM m1 WINDOW w AS (PARTITION BY sequence_id ORDER BY {RANK})),
 res AS (SELECT doc_id, sequence_id, seq, lang, source, CASE WHEN lost THEN 'exclude' ELSE decision END AS decision, dup_seq, CASE WHEN lost THEN best END AS dup_id,
  CASE WHEN lost THEN list_sort(list_append(list_filter(reasons, lambda r: r <> '{curate.PASSES}'), '{curate.DUPLICATE_ID}')) ELSE reasons END AS reasons FROM p2)"""


def classified(spark, d):
    return curate.classify(records_view(spark, d), RULES)


def resolved(spark, d):
    return curate.resolve_duplicates(classified(spark, d))


@query("classify_records", f"{CLASSIFIED} SELECT doc_id, sequence_id, decision, array_to_string(reasons, ';') AS reasons FROM cl")
def classify_records(spark, d):
    return classified(spark, d).select(F.col("seq_order").alias("doc_id"), "sequence_id", "decision", F.array_join("reasons", ";").alias("reasons"))


@query("resolve_duplicates", f"{RESOLVED} SELECT doc_id, sequence_id, decision, dup_seq, dup_id, array_to_string(reasons, ';') AS reasons FROM res")
def resolve_duplicates(spark, d):
    return resolved(spark, d).select(F.col("seq_order").alias("doc_id"), "sequence_id", "decision", F.col("duplicate_sequence_of").alias("dup_seq"), F.col("duplicate_id_of").alias("dup_id"), F.array_join("reasons", ";").alias("reasons"))


@query("cleaning_summary", f"""{RESOLVED} SELECT 'decision' AS kind, decision AS name, count(*) AS n FROM res GROUP BY decision
 UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(reasons) AS r FROM res WHERE decision <> 'include') GROUP BY r
 UNION ALL SELECT 'organism', lang, count(*) FROM res WHERE decision = 'include' GROUP BY lang
 UNION ALL SELECT 'length', x, v FROM (SELECT unnest(['min', 'max', 'total']) AS x, unnest([min(length(seq)), max(length(seq)), sum(length(seq))])::BIGINT AS v FROM res WHERE decision = 'include')""")  # fmt: skip
def cleaning_summary(spark, d):
    rows = stored(resolved(spark, d).select("decision", "reasons", "organism", F.length("sequence").cast("long").alias("n")), "resolved")
    kept = rows.where("decision = 'include'")
    organisms = kept.groupBy(F.col("organism").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("organism").alias("kind"), "name", "n")
    n = F.col("n")
    lengths = kept.agg(F.array(F.struct(F.lit("min").alias("name"), F.min(n).alias("n")), F.struct(F.lit("max").alias("name"), F.max(n).alias("n")), F.struct(F.lit("total").alias("name"), F.sum(n).alias("n"))).alias("x"))
    lengths = lengths.select(F.explode("x").alias("x")).select(F.lit("length").alias("kind"), "x.*")
    return curate.reason_counts(rows).unionByName(organisms).unionByName(lengths)


@query("candidate_selection", f"""{CLASSIFIED}, k AS (SELECT *, list_filter(string_split(reasons, ';'), lambda r: NOT starts_with(r, 'invalid_amino_acids')) AS left_over FROM (SELECT doc_id, sequence_id, seq, lang, source, array_to_string(reasons, ';') AS reasons FROM cl)), c AS (SELECT * FROM k WHERE left_over = ['domain_not_confirmed'])
 SELECT doc_id, count(*) OVER (PARTITION BY sequence_id) = 1 AS unique_id, count(*) OVER (PARTITION BY seq) = 1 AS unique_sequence, regexp_full_match(seq, '[{A}]*') AS legal, upper(lang) = '{RULES.region}' AS region, contains(upper(source), '{RULES.xref}') AS xref, length(seq) BETWEEN 200 AND 4000 AS length_ok FROM c""")
def candidate_selection(spark, d):
    # The invented texts hold every letter, so the reason of illegal letters is not counted here.
    checks = {"legal": R.is_legal(F.col("sequence")), "region": F.upper("region_names") == RULES.region, "xref": F.upper("cdd_xrefs").contains(RULES.xref), "length_ok": F.length("sequence").between(200, 4000)}
    rows = classified(spark, d).select("seq_order", "sequence_id", "sequence", "reasons", "region_names", "cdd_xrefs")
    return curate.candidates(rows, "domain_not_confirmed", "invalid_amino_acids", checks).select(F.col("seq_order").alias("doc_id"), "unique_id", "unique_sequence", *checks)


@query("domain_counts", f"{with_views(DOCS_SQL)} SELECT CASE WHEN trim(split_part(text, ' ', 1)) = '' THEN 'Unclassified' ELSE split_part(text, ' ', 1) END AS domain, count(*) AS n FROM docs GROUP BY 1")
def domain_counts(spark, d):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return table(spark, d, "documents").groupBy(F.when(F.trim(first) == "", "Unclassified").otherwise(first).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_header_fields", "SELECT page_id, regexp_extract(url, 'page=([0-9]+)', 1) AS page, regexp_extract(url, 'ref=([a-z]+)', 1) AS ref, regexp_extract(url, '/([^/?#]+)[^/]*$', 1) AS last FROM pages")
def parse_header_fields(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.regexp_extract("url", "page=([0-9]+)", 1).alias("page"), F.regexp_extract("url", "ref=([a-z]+)", 1).alias("ref"), F.regexp_extract("url", "/([^/?#]+)[^/]*$", 1).alias("last"))


TOKEN_SQL = "CASE doc_id % 5 WHEN 0 THEN 'sp|' || source || '|x' WHEN 1 THEN 'tr|' || lang || '|y' WHEN 2 THEN 'pdb|' || source || '|' || lang WHEN 3 THEN 'pir|a|' || source ELSE source END"
ACCESSION_SQL = f"WITH t AS (SELECT doc_id, {TOKEN_SQL} AS tok FROM documents) SELECT doc_id, CASE WHEN tok LIKE 'sp|%' OR tok LIKE 'tr|%' THEN split_part(tok, '|', 2) WHEN tok LIKE 'pdb|%' THEN split_part(tok, '|', 2) || '_' || split_part(tok, '|', 3) WHEN tok LIKE 'pir|%' THEN split_part(tok, '|', -1) ELSE tok END AS accession FROM t"


@query("normalize_accession", ACCESSION_SQL)
def normalize_accession(spark, d):
    token = F.expr(TOKEN_SQL)
    return table(spark, d, "documents").select("doc_id", R.normalize_accession(token).alias("accession"))


@query("parse_species_chain", "SELECT doc_id, split_part(source, 'c', 1) AS species, CASE WHEN lang = 'en' THEN upper(substr(source, 4, 1)) ELSE '?' END AS chain FROM documents")
def parse_species_chain(spark, d):
    return table(spark, d, "documents").select("doc_id", F.split_part("source", F.lit("c"), F.lit(1)).alias("species"), F.when(F.col("lang") == "en", F.upper(F.substring("source", 4, 1))).otherwise("?").alias("chain"))


DESCRIBED_SQL = "SELECT doc_id, 'id run_id=' || source || ' model=' || lang || '=x ' || CASE WHEN doc_id % 3 = 0 THEN '[old] [' || lang || ' ' || source || ' ] ' WHEN doc_id % 3 = 1 THEN '=none model=second' ELSE '[open' END AS h FROM documents"


@query("header_tags", f"WITH t AS ({DESCRIBED_SQL}) SELECT doc_id, regexp_extract(h, 'run_id=([^ ]*)', 1) AS run_id, regexp_extract(h, 'model=([^ ]*)', 1) AS model, len(regexp_extract_all(h, '(^| )[^ =]+=')) AS n_tags, trim(regexp_extract(h, '\\[([^\\[\\]]+)\\]\\s*$', 1)) AS organism FROM t")
def header_tags(spark, d):
    last = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[old] ["), "lang", F.lit(" "), "source", F.lit(" ] "))).when(F.col("doc_id") % 3 == 1, "=none model=second").otherwise("[open")
    h = F.concat(F.lit("id run_id="), "source", F.lit(" model="), "lang", F.lit("=x "), last)
    rows = table(spark, d, "documents").select("doc_id", h.alias("h"))
    return rows.select("doc_id", headers.tag(F.col("h"), "run_id").alias("run_id"), headers.tag(F.col("h"), "model").alias("model"), F.size(headers.tags(F.col("h"))).cast("long").alias("n_tags"), headers.trailing_organism(F.col("h")).alias("organism"))


NAMES_SQL = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'sp|P' || doc_id || '|GVP' || upper(substr(source, 4)) || 'M2_' || upper(lang) WHEN 1 THEN 'WP_' || doc_id WHEN 2 THEN 'Gvp' || lang || '_' || source || '_' || lang WHEN 3 THEN 'tr|A|' || lang ELSE source END AS h FROM documents"


@query("species_chain", f"""WITH t AS ({NAMES_SQL}), p AS (SELECT *, split_part(h, '|', -1) AS e FROM t) SELECT doc_id,
 CASE WHEN doc_id % 5 IN (0, 3) THEN CASE WHEN contains(e, '_') THEN split_part(e, '_', -1) ELSE 'unknown' END WHEN doc_id % 5 = 1 THEN 'unknown' WHEN contains(h, '_') THEN substr(h, strpos(h, '_') + 1) ELSE 'unknown' END AS species,
 CASE WHEN doc_id % 5 = 0 THEN substr(e, 4, 1) WHEN doc_id % 5 = 2 THEN upper(lang_) END AS chain FROM (SELECT p.*, d.lang AS lang_ FROM p JOIN documents d USING (doc_id))""")
def species_chain(spark, d):
    by = F.col("doc_id") % 5
    named = F.concat(F.lit("sp|P"), F.col("doc_id").cast("string"), F.lit("|GVP"), F.upper(F.col("source").substr(4, 99)), F.lit("M2_"), F.upper("lang"))
    h = F.when(by == 0, named).when(by == 1, F.concat(F.lit("WP_"), F.col("doc_id").cast("string"))).when(by == 2, F.concat(F.lit("Gvp"), "lang", F.lit("_"), "source", F.lit("_"), "lang")).when(by == 3, F.concat(F.lit("tr|A|"), "lang")).otherwise(F.col("source"))
    rows = table(spark, d, "documents").select("doc_id", h.alias("h"))
    return rows.select("doc_id", headers.species(F.col("h")).alias("species"), headers.chain(F.col("h")).alias("chain"))


@query("write_fasta", f"{with_views(SEQS_SQL)} SELECT doc_id, md5('>' || doc_id || ' run_id=' || source || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10))) AS record_md5 FROM seqs WHERE seq <> ''")
def write_fasta(spark, d):
    from bioloom.sources import sequences

    lines = sequences.fasta_lines(views.seqs(spark, d), "doc_id", F.concat(F.lit("run_id="), "source"), "seq")
    return lines.select("doc_id", F.md5(F.col("record").cast("binary")).alias("record_md5"))


# --- joins and sets -------------------------------------------------------------------------------------------

MAPS_SQL = "m95 AS (SELECT min(doc_id) OVER (PARTITION BY text) AS rep95, doc_id FROM documents), m90 AS (SELECT min(doc_id) OVER (PARTITION BY source, lang) AS rep90, doc_id FROM documents), c AS (SELECT m95.doc_id, rep95, count(*) OVER (PARTITION BY rep95) AS n95, rep90, count(*) OVER (PARTITION BY rep90) AS n90 FROM m95 JOIN m90 USING (doc_id))"


def cluster_maps(spark, d):
    docs = table(spark, d, "documents")
    by_text = docs.select(F.min("doc_id").over(Window.partitionBy(F.xxhash64("text"), "text")).alias("representative"), F.col("doc_id").alias("member"))
    by_source = docs.select(F.min("doc_id").over(Window.partitionBy("source", "lang")).alias("representative"), F.col("doc_id").alias("member"))
    return {"c95": by_text, "c90": by_source}


@query("join_clusters", f"WITH {MAPS_SQL} SELECT doc_id, rep95 AS c95_representative, n95 AS c95_size, round(1.0::DOUBLE / n95, 8) AS c95_weight, rep90 AS c90_representative, n90 AS c90_size, round(1.0::DOUBLE / n90, 8) AS c90_weight FROM c")
def join_clusters(spark, d):
    return curate.join_clusters(table(spark, d, "documents").select("doc_id"), cluster_maps(spark, d), "doc_id")


@query("cluster_map_checks", "WITH m AS (SELECT doc_id FROM documents WHERE lang <> 'es' UNION ALL SELECT doc_id + 1000000 FROM labels WHERE toxic = 1) SELECT coalesce(d.doc_id, m.doc_id) AS doc_id, CASE WHEN m.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM documents d FULL OUTER JOIN m ON d.doc_id = m.doc_id WHERE d.doc_id IS NULL OR m.doc_id IS NULL")
def cluster_map_checks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    strangers = table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id") + 1000000).alias("member"))
    return curate.map_problems(rows, rows.where("lang <> 'es'").select(F.col("doc_id").alias("member")).unionByName(strangers), "doc_id")


@query("cluster_balanced_weight", f"WITH {MAPS_SQL} SELECT doc_id, round(1.0::DOUBLE / n95, 8) AS weight, doc_id = rep95 AS is_representative FROM c")
def cluster_balanced_weight(spark, d):
    rows = curate.join_clusters(table(spark, d, "documents").select("doc_id"), {"c": cluster_maps(spark, d)["c95"]}, "doc_id")
    return rows.select("doc_id", F.col("c_weight").alias("weight"), (F.col("doc_id") == F.col("c_representative")).alias("is_representative"))


@query("cluster_summary", f"WITH {MAPS_SQL} SELECT 'c95' AS level, count(DISTINCT rep95) AS n_clusters, max(n95) AS largest, round(max(n95) / count(*), 4) AS fraction FROM c UNION ALL SELECT 'c90', count(DISTINCT rep90), max(n90), round(max(n90) / count(*), 4) FROM c")
def cluster_summary(spark, d):
    out = None
    for level, m in cluster_maps(spark, d).items():
        sizes = m.groupBy("representative").agg(F.count(F.lit(1)).alias("size"))
        one = sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.max("size").alias("largest"), F.round(F.max("size") / F.sum("size"), 4).alias("fraction")).select(F.lit(level).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    return out


COPY_SQL = f"{with_views(SEQS_SQL)}, ref AS (SELECT DISTINCT seq FROM seqs WHERE source = '{views.REFERENCE_RUN}')"


@query("exact_copy", f"{COPY_SQL} SELECT doc_id, seq IN (SELECT seq FROM ref) AS exact_copy FROM seqs WHERE source <> '{views.REFERENCE_RUN}'")
def exact_copy(spark, d):
    s = views.seqs(spark, d).withColumn("hash", F.xxhash64("seq"))
    ref = s.where(F.col("source") == views.REFERENCE_RUN).select("hash", "seq").distinct().withColumn("hit", F.lit(True))
    return s.where(F.col("source") != views.REFERENCE_RUN).join(ref, ["hash", "seq"], "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("exact_copy"))


@query("new_sequences", f"{COPY_SQL} SELECT doc_id FROM seqs WHERE seq NOT IN (SELECT seq FROM ref)")
def new_sequences(spark, d):
    s = views.seqs(spark, d).withColumn("hash", F.xxhash64("seq"))
    ref = s.where(F.col("source") == views.REFERENCE_RUN).select("hash", "seq")
    return s.join(ref, ["hash", "seq"], "left_anti").select("doc_id")


@query("coverage_audit", f"""{with_views(SEQS_SQL)}, ref AS (SELECT DISTINCT seq FROM seqs WHERE source = '{views.REFERENCE_RUN}'), one AS (SELECT DISTINCT source, seq FROM seqs WHERE source <> '{views.REFERENCE_RUN}')
 SELECT source, count(*) AS n_distinct, count(ref.seq) AS n_covered, count(*) - count(ref.seq) AS n_new, round(count(ref.seq) / count(*), 10) AS coverage FROM one LEFT JOIN ref USING (seq) GROUP BY source""")  # fmt: skip
def coverage_audit(spark, d):
    s = views.seqs(spark, d).select("source", F.xxhash64("seq").alias("hash"), "seq")
    ref = s.where(F.col("source") == views.REFERENCE_RUN).select("hash", "seq").distinct().withColumn("hit", F.lit(1))
    one = s.where(F.col("source") != views.REFERENCE_RUN).distinct().join(ref, ["hash", "seq"], "left")
    return one.groupBy("source").agg(F.count(F.lit(1)).alias("n_distinct"), F.count("hit").alias("n_covered"), F.count_if(F.col("hit").isNull()).alias("n_new"), F.round(F.count("hit") / F.count(F.lit(1)), 10).alias("coverage"))


@query("rescue_merge", f"""{with_views(SEQS_SQL)}, base AS (SELECT doc_id, seq FROM seqs WHERE lang = 'en'), known AS (SELECT seq, min(doc_id) AS dup FROM base GROUP BY seq)
 SELECT doc_id, 'include' AS decision, NULL::BIGINT AS duplicate_sequence_of, 'strict' AS admission_route FROM base UNION ALL
 SELECT s.doc_id, CASE WHEN dup IS NULL THEN 'include' ELSE 'exclude' END, dup, CASE WHEN dup IS NULL THEN 'profile' END FROM seqs s LEFT JOIN known USING (seq) WHERE lang <> 'en'""")  # fmt: skip
def rescue_merge(spark, d):
    s = views.seqs(spark, d).select("doc_id", "seq", "lang")
    return curate.rescue_merge(s.where("lang = 'en'"), s.where("lang <> 'en'"), "seq", "doc_id", "profile").select("doc_id", "decision", "duplicate_sequence_of", "admission_route")


ADJ_SQL = f"""{CLASSIFIED}, rv AS (SELECT * FROM cl WHERE decision = 'review'), fl AS (SELECT min(length(seq)) AS f FROM cl WHERE decision = 'include'),
 j AS (SELECT doc_id, seq, quality, (lang = 'en') AS off, length(seq)::DOUBLE AS core, f, contains(lower(source), '1') AS ann FROM rv CROSS JOIN fl),
 k AS (SELECT doc_id, list_filter([CASE WHEN length(seq) NOT BETWEEN 300 AND 3000 THEN 'length_outside_300_3000' END, CASE WHEN NOT off THEN 'official_profile_failed' END,
 CASE WHEN NOT coalesce(core >= f, false) THEN 'below_core_score_floor' END, CASE WHEN NOT ann THEN 'insufficient_annotation' END, CASE WHEN NOT regexp_full_match(seq, '[{A}]*') THEN 'invalid_amino_acids' END], lambda x: x IS NOT NULL) AS bad FROM j)
 SELECT doc_id, CASE WHEN len(bad) = 0 THEN 'rescue' ELSE 'exclude' END AS profile_decision, CASE WHEN len(bad) = 0 THEN 'passes_profile_review' ELSE array_to_string(bad, ';') END AS profile_reasons FROM k"""


@query("adjudicate_profile", ADJ_SQL)
def adjudicate_profile(spark, d):
    # Filtered only when stored, as each filter would work out all rules anew; excluded sequences aren't looked at again.
    judged = classified(spark, d).select(F.col("seq_order").alias("sequence_id"), "lang", "decision", F.lower("source").contains("1").alias("annotation_support"), F.when(F.col("decision") != "exclude", F.col("sequence")).alias("sequence"))
    rows = stored(judged, "judged")
    review = rows.where("decision = 'review'")
    hits = lambda df: df.select("sequence_id", F.length("sequence").cast("double").alias("score"))
    out = curate.adjudicate(review, hits(review.where("lang = 'en'")), hits(review), hits(rows.where("decision = 'include'")), 300, 3000)
    return out.select(F.col("sequence_id").alias("doc_id"), "profile_decision", "profile_reasons")


@query("source_set_ops", "WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels WHERE quality = 1), u AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b) SELECT doc_id, doc_id IN (SELECT doc_id FROM a) AS in_lang, doc_id IN (SELECT doc_id FROM b) AS in_quality, (doc_id IN (SELECT doc_id FROM a)) AND (doc_id IN (SELECT doc_id FROM b)) AS in_both FROM u")
def source_set_ops(spark, d):
    sets = {"lang": table(spark, d, "documents").where("lang = 'en'"), "quality": table(spark, d, "labels").where("quality = 1")}
    return curate.set_relations(sets, "doc_id").withColumn("in_both", F.col("in_lang") & F.col("in_quality"))


ID_SETS_SQL = f"""{with_views(RAW_SQL)}, fa AS (SELECT doc_id, seq FROM raw_seqs UNION ALL SELECT doc_id, seq FROM raw_seqs WHERE length(seq) % 10 = 3), al AS (SELECT doc_id, CASE WHEN length(seq) % 10 = 7 THEN substr(seq, 2) ELSE seq END AS a FROM raw_seqs WHERE length(seq) % 10 <> 5),
 ids AS (SELECT doc_id FROM fa UNION SELECT doc_id FROM al UNION SELECT doc_id + 1 FROM labels UNION SELECT doc_id FROM labels WHERE quality = 1), f AS (SELECT doc_id, count(*) AS n, any_value(seq) AS seq FROM fa GROUP BY doc_id),
 own AS (SELECT seq, min(doc_id) AS owner FROM fa WHERE seq <> '' GROUP BY seq HAVING count(DISTINCT doc_id) > 1),
 v AS (SELECT ids.doc_id, list_sort(list_filter([CASE WHEN f.n IS NULL THEN 'not_in_fasta' END, CASE WHEN al.a IS NULL THEN 'not_in_msa' END, CASE WHEN ids.doc_id NOT IN (SELECT doc_id + 1 FROM labels) THEN 'not_in_metadata' END, CASE WHEN ids.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'not_in_profile' END,
  CASE WHEN n > 1 THEN 'repeated_id' END, CASE WHEN owner <> ids.doc_id THEN 'repeated_sequence' END, CASE WHEN f.seq <> al.a THEN 'msa_sequence_differs' END, CASE WHEN NOT regexp_full_match(f.seq, '[{A}]*') THEN 'illegal_letters' END, CASE WHEN length(f.seq) NOT BETWEEN 50 AND 20000 THEN 'length' END], lambda x: x IS NOT NULL)) AS v
  FROM ids LEFT JOIN f USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN own ON own.seq = f.seq)
 SELECT doc_id, array_to_string(v, ';') AS violations FROM v WHERE len(v) > 0"""


@query("id_set_checks", ID_SETS_SQL)
def id_set_checks(spark, d):
    """Sources made from the documents so that every rule is broken by some: rows twice, missing and shortened aligned rows, shifted metadata."""
    rows, labels = stored(views.raw_seqs(spark, d).select("doc_id", "seq"), "sequences"), table(spark, d, "labels")
    last = F.length("seq") % 10
    fasta = rows.unionByName(rows.where(last == 3))
    alignment = rows.where(last != 5).select("doc_id", F.concat(F.lit("-"), F.when(last == 7, F.expr("substring(seq, 2)")).otherwise(F.col("seq")), F.lit("--")).alias("aligned"))
    metadata, profile = labels.select((F.col("doc_id") + 1).alias("doc_id")), labels.where("quality = 1").select("doc_id")
    return curate.id_set_checks(fasta, alignment, metadata, profile, "doc_id", "seq", "aligned", 50, 20000)


SPLIT_SQL = split_sql("c")
FROZEN = ("dataset_version", "doc_id", "frozen", "lang", "seq", "source", "split")
CELLS = " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FROZEN)
FIGURES = "count(*) AS n_records, sum(length(seq))::BIGINT AS n_residues, min(length(seq)) AS min_length, max(length(seq)) AS max_length, bit_xor(digest) AS hash_xor, sum(digest)::VARCHAR AS hash_sum, max(dataset_version) AS dataset_version FROM x"


@query("freeze_dataset", f"""WITH RECURSIVE {SEQS_SQL}, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, lang) AS component FROM documents), {SPLIT_SQL}, one AS (SELECT min(doc_id) AS doc_id FROM seqs WHERE seq <> '' GROUP BY seq),
 r AS (SELECT doc_id, source, lang, seq, split, 'v1' AS dataset_version, true AS frozen FROM one JOIN seqs USING (doc_id) JOIN c USING (doc_id) JOIN parts USING (component)), x AS (SELECT *, ('0x' || substr(md5({CELLS}), 1, 15))::BIGINT AS digest FROM r)
 SELECT split, {FIGURES} GROUP BY split UNION ALL SELECT 'all', {FIGURES}""")
def freeze_dataset(spark, d):
    """One record of each sequence, split without leaks, frozen in a new folder: what its manifest says."""
    seqs = views.seqs(spark, d)
    once = seqs.where("seq != ''").groupBy("seq").agg(F.min_by(F.struct("doc_id", "source", "lang"), "doc_id").alias("r")).select("r.*", "seq")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    first = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("component"))
    in_group = lambda rows: rows.join(first.select(F.col("source").alias("s"), F.col("lang").alias("l"), "component"), F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l"))).drop("s", "l")
    splits = stored(cluster.leakfree_split(in_group(docs).select("doc_id", "component")), "splits").select("component", "split")
    rows = stored(in_group(once).join(splits, "component").drop("component"), "rows")
    return freeze.freeze(rows, f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}", "v1", "doc_id", "seq")


# --- record database ------------------------------------------------------------------------------------------

NORM_SQL = "SELECT doc_id, CASE WHEN coalesce(trim(lang), '') = '' OR contains(lower(lang), 'uncultur') THEN 'un' ELSE lang END AS organism, CASE WHEN lower(trim(toxic::VARCHAR)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(toxic::VARCHAR)) IN ('false', '0', 'no') THEN false END AS toxic_flag, try_cast(replace(source, 'src', '') AS DOUBLE) AS source_number, coalesce(nullif(n_chars, 0), length(text)) AS n_chars FROM docs"


@query("normalize_records", f"{with_views(DOCS_SQL)} {NORM_SQL}")
def normalize_records(spark, d):
    return views.docs(spark, d).select(
        "doc_id", records.clean_organism(F.col("lang")).alias("organism"), records.as_flag(F.col("toxic").cast("string")).alias("toxic_flag"),
        records.as_number(F.replace("source", F.lit("src"))).alias("source_number"), F.coalesce(F.nullif("n_chars", F.lit(0)), F.length("text")).alias("n_chars"),
    )


UPSERT_KEYS = ["source", "lang", "quality", "toxic"]
UPSERT_SQL = "WITH docs AS (SELECT d.*, coalesce(quality, -1) AS q, coalesce(toxic, -1) AS t FROM documents d LEFT JOIN labels USING (doc_id)), b AS (SELECT *, CASE WHEN n_chars < 2000 THEN 0 ELSE 1 END AS load FROM docs)"


@query("upsert_records", f"{UPSERT_SQL} SELECT 'append' AS mode, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, q, t ORDER BY load, doc_id) AS p FROM b) WHERE p = 1 UNION ALL SELECT 'update', doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, q, t ORDER BY load DESC, doc_id DESC) AS p FROM b) WHERE p = 1 UNION ALL SELECT 'overwrite', doc_id FROM b WHERE load = 1")
def upsert_records(spark, d):
    rows = views.docs(spark, d).fillna(-1, ["quality", "toxic"]).withColumn("load_order", F.col("doc_id"))
    old, new = rows.where("n_chars < 2000"), rows.where("n_chars >= 2000")
    out = [records.upsert(old, new, UPSERT_KEYS, m).select(F.lit(m).alias("mode"), "doc_id") for m in ("append", "update", "overwrite")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("filter_records", f"{with_views(DOCS_SQL)} SELECT doc_id FROM docs WHERE source IN ('src1', 'src2', 'src3') AND (contains(lower(text), 'tion.') OR contains(lower(lang), 'tion.')) AND n_chars >= 200 AND n_chars <= 9000 AND quality = 1")
def filter_records(spark, d):
    return records.filter_records(views.docs(spark, d), {"source": ["src1", "src2", "src3"]}, ("TION.", ["text", "lang"]), {"n_chars": (200, 9000)}, ["quality"]).select("doc_id")


@query("search_records", f"""{with_views(SEQS_SQL)} SELECT doc_id, 'accession' AS kind, 0::BIGINT AS position FROM seqs WHERE source = 'src1' UNION ALL SELECT doc_id, 'anywhere', instr(seq, 'THATS')::BIGINT FROM seqs WHERE contains(seq, 'THATS')
 UNION ALL SELECT doc_id, 'window', instr(substr(seq, 11, 300), 'THE')::BIGINT + 10 FROM seqs WHERE contains(substr(seq, 11, 300), 'THE')""")
def search_records(spark, d):
    rows = views.seqs(spark, d)
    by_accession = records.by_accession(rows, "source", "  src1 ").select("doc_id", F.lit("accession").alias("kind"), F.lit(0).cast("long").alias("position"))
    anywhere = records.by_subsequence(rows, "seq", "thats").select("doc_id", F.lit("anywhere").alias("kind"), "position")
    window = records.by_subsequence(rows, "seq", "the", 11, 310).select("doc_id", F.lit("window").alias("kind"), "position")
    return by_accession.unionByName(anywhere).unionByName(window)


@query("rank_sort", f"{with_views(DOCS_SQL)} SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 9999 END, quality ASC NULLS LAST, n_chars DESC, doc_id)::INTEGER AS place FROM docs")
def rank_sort(spark, d):
    order = [records.fixed_rank(F.col("lang"), ["fr", "en"]).alias("rank"), "quality", "n_chars", "doc_id"]
    listed = numbered(views.docs(spark, d).select(*order), F.col("rank"), F.col("quality").asc_nulls_last(), F.col("n_chars").desc(), F.col("doc_id"))
    return listed.select("doc_id", F.col("place").cast("int").alias("place"))


@query("readonly_sql", f"{with_views(DOCS_SQL)} SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM docs GROUP BY source, lang")
def readonly_sql(spark, d):
    return records.readonly_sql(spark, {"region_records": views.docs(spark, d)}, "SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM region_records GROUP BY source, lang", None)


@query("record_statistics", f"{with_views(DOCS_SQL)} SELECT source, count(*) AS n, count(quality) AS n_labelled, count(*) FILTER (toxic = 1) AS n_toxic, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars, quantile_cont(n_chars, 0.5) AS median_chars FROM docs GROUP BY source")
def record_statistics(spark, d):
    docs = views.docs(spark, d)
    found = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
    )
    middle = records.grouped_quantiles(table(spark, d, "documents"), "source", "n_chars", {"median_chars": 0.5}).withColumnRenamed("source", "of")
    return found.join(middle, F.col("source").eqNullSafe(F.col("of"))).drop("of")


@query("record_totals", f"{with_views(DOCS_SQL)} SELECT count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_languages, count(quality) AS n_labelled, round(avg(quality), 8) AS mean_quality, sum(n_chars)::BIGINT AS chars FROM docs")
def record_totals(spark, d):
    return views.docs(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_languages"), F.count("quality").alias("n_labelled"),
        F.round(F.avg("quality"), 8).alias("mean_quality"), F.sum("n_chars").alias("chars"),
    )


TYPES = ["src3", "src1", "src0"]
TYPE_RANK = "CASE source " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(TYPES)) + " ELSE 9999 END"


@query("record_types", f"SELECT source, count(*) AS n, row_number() OVER (ORDER BY min({TYPE_RANK}), source)::INTEGER AS place FROM documents GROUP BY source")
def record_types(spark, d):
    # One row a type is left before they are put in order.
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(records.fixed_rank(F.col("source"), TYPES), "source")))


TOP_COLUMNS = ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey"]
TOP_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::BIGINT::VARCHAR AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}" if c in ("l_quantity", "l_suppkey") else f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}" for c in TOP_COLUMNS)


@query("table_top_values", f"WITH v AS ({TOP_SQL}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value)::INTEGER AS place FROM v) WHERE place <= 10")
def table_top_values(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("l_quantity"), F.col("l_suppkey").cast("long").alias("l_suppkey"))
    return records.top_values(rows, TOP_COLUMNS, 10)


PROFILE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM lineitem" for c in PROFILE)


@query("table_profile", PROFILE_SQL)
def table_profile(spark, d):
    return records.describe(table(spark, d, "lineitem"), PROFILE).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("table_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for i, a in enumerate(PROFILE) for b in PROFILE[i + 1 :]))
def table_correlations(spark, d):
    return records.correlations(table(spark, d, "lineitem"), PROFILE).withColumn("r", F.round("r", 8))


@query("table_nulls", f"{with_views(DOCS_SQL)} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, round(count({c}) / count(*) * 100, 6) AS completeness FROM docs" for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")))
def table_nulls(spark, d):
    return records.null_profile(views.docs(spark, d)).withColumn("completeness", F.round("completeness", 6))


@query("table_histogram", "WITH e AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem) SELECT least(20, floor((l_extendedprice - low) / ((high - low) / 20)) + 1)::INTEGER AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def table_histogram(spark, d):
    return records.histogram(table(spark, d, "lineitem"), "l_extendedprice")


@query("sensitivity_corr", "SELECT l_returnflag, outcome, round(r, 8) AS r, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(r) DESC, outcome)::INTEGER AS place FROM (SELECT l_returnflag, unnest(['price', 'discount', 'tax']) AS outcome, unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_quantity, l_tax)]) AS r FROM lineitem GROUP BY l_returnflag)")
def sensitivity_corr(spark, d):
    pairs = {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.array(*[F.struct(F.lit(k).alias("outcome"), F.corr("l_quantity", c).alias("r")) for k, c in pairs.items()]).alias("x"))
    rows = rows.select("l_returnflag", F.explode("x").alias("x")).select("l_returnflag", "x.*")
    place = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.abs("r").desc(), "outcome"))
    return rows.withColumn("place", place).withColumn("r", F.round("r", 8))
