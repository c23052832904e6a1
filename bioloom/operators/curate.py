"""Classifying records with reasons, resolving duplicates, reviewing and merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bioloom.functions import residues as R
from bioloom.session import stored

PASSES = "passes_strict_taxonomy_annotation_and_sequence_checks"
DUPLICATE_SEQUENCE, DUPLICATE_ID = "exact_duplicate_sequence", "duplicate_sequence_id"


@dataclass(frozen=True)
class Rules:
    """What a family's curation asks for; patterns are searched without regard to case."""

    # The default family's terms and patterns.
    lineage: tuple[str, ...] = ("cyanobacteriota", "cyanobacteria", "cyanophyceae")
    explicit: str = r"gas\s+vesicle\s+(?:structural\s+)?protein\s+gvp\s*a|gvp\s*a\s+family\s+protein"
    other: str = r"gvp\s*(?:j|m|k|s)"
    ambiguous: str = r"synthesis[- ]like|gvpa[- ]like|hypothetical|uncharacterized"
    partial: str = r"partial|fragment|incomplete"
    region: str = "PRK09371"
    xref: str = "CDD:181805"
    min_length: int = 50
    max_length: int = 150


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i)(?:^|[^A-Za-z0-9_])(?:{pattern})(?:[^A-Za-z0-9_]|$)")


def classify(records: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds ``decision`` and ``reasons`` (sorted, unique) before duplicates are looked at.

    Columns read: ``sequence, header, has_metadata, meta_sequence, taxonomy, organism, definition, products,
    genes, comments, partial5, partial3, complete_by_feature, region_names, cdd_xrefs``; nulls count as empty or
    false. Any reason to exclude outweighs reasons to review.
    """
    seq, blank = F.coalesce("sequence", F.lit("")), F.lit("")
    text = F.concat_ws(" | ", F.coalesce("definition", blank), F.coalesce("products", blank))
    has = F.coalesce("has_metadata", F.lit(False))
    lineage = F.lower(F.concat_ws("; ", F.coalesce("taxonomy", blank), F.coalesce("organism", blank)))
    related = R.total([lineage.contains(t).cast("int") for t in rules.lineage]) > 0
    members = lambda c: F.transform(F.split(F.coalesce(c, blank), r"\|"), lambda x: F.upper(F.trim(x)))
    explicit = _found(text, rules.explicit) | (F.array_contains(members("genes"), "GVPA") & F.lower(text).contains("gas vesicle"))
    other = _found(text, rules.other)
    partial = _found(F.concat_ws(" | ", F.coalesce("header", blank), F.coalesce("definition", blank), F.coalesce("comments", blank)), rules.partial)
    partial = partial | F.coalesce("partial5", F.lit(False)) | F.coalesce("partial3", F.lit(False))
    complete = F.lower(F.coalesce("comments", blank)).contains("completeness: full length") | F.coalesce("complete_by_feature", F.lit(False))
    confirmed = F.array_contains(members("region_names"), rules.region.upper()) & F.array_contains(members("cdd_xrefs"), rules.xref.upper())
    meta = F.coalesce("meta_sequence", blank)
    exclude = F.array_compact(F.array(
        F.when(seq == "", "empty_sequence"),
        F.when(~R.is_legal(seq), F.concat(F.lit("invalid_amino_acids:"), F.array_join(R.illegal_letters(seq), ""))),
        F.when(has & ~related, "outside_lineage"),
        F.when(has & other, "annotated_as_other_family_member"),
        F.when(has & ~other & ~explicit & _found(text, rules.ambiguous), "ambiguous_annotation"),
        F.when(has & partial, "partial_fragment_or_incomplete"),
    ))
    review = F.array_compact(F.array(
        F.when(~has, "metadata_not_retrieved"),
        F.when(has & (meta != "") & (meta != seq), "sequence_differs_from_metadata"),
        F.when(has & ~other & ~explicit & ~_found(text, rules.ambiguous), "identity_not_explicit"),
        F.when(has & ~partial & ~complete, "full_length_not_confirmed"),
        F.when(has & ~confirmed, "domain_not_confirmed"),
        F.when(~F.length(seq).between(rules.min_length, rules.max_length), f"length_outside_review_range:{rules.min_length}-{rules.max_length}"),
    ))
    made = records.withColumn("exclude_", exclude).withColumn("review_", review)
    decision = F.when(F.size("exclude_") > 0, "exclude").when(F.size("review_") > 0, "review").otherwise("include")
    reasons = F.when(decision == "include", F.array(F.lit(PASSES))).otherwise(F.array_sort(F.array_distinct(F.concat("exclude_", "review_"))))
    return made.withColumn("decision", decision).withColumn("reasons", reasons).drop("exclude_", "review_")


def _rank() -> Column:
    return F.struct(
        F.when(F.col("decision") == "include", 0).when(F.col("decision") == "review", 1).otherwise(2),
        F.when(F.col("sequence_id").startswith("WP_"), 0).otherwise(1), F.col("seq_order"),
    )


def _mark(rows: DataFrame, key: str, reason: str, pointer: str) -> DataFrame:
    """Of rows that share ``key`` all but the best are excluded and point to it; the best is an aggregate, so no group meets in one task."""
    shared = rows.groupBy(F.col(key).alias("of_")).agg(F.min(F.struct(_rank().alias("rank"), "sequence_id")).alias("best_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    lost = F.coalesce(_rank() != F.col("best_.rank"), F.lit(False))
    joined = rows.join(shared.drop("n_"), F.col(key).eqNullSafe(F.col("of_")), "left").withColumn("lost_", lost)
    kept = F.filter("reasons", lambda r: r != PASSES)
    return joined.withColumns({
        "reasons": F.when(F.col("lost_"), F.array_sort(F.array_union(kept, F.array(F.lit(reason))))).otherwise(F.col("reasons")),
        "decision": F.when(F.col("lost_"), "exclude").otherwise(F.col("decision")), pointer: F.when(F.col("lost_"), F.col("best_.sequence_id")),
    }).drop("of_", "best_", "lost_")


def resolve_duplicates(rows: DataFrame) -> DataFrame:
    """Keeps the best record of each sequence, then of each id as the first pass left them.

    Best: included before reviewed before excluded, ``WP_`` ids first, then input order (``seq_order``, which no two records share).
    Empty and null sequences are no duplicates of each other; records without an id share one. Only order, id, decision, reasons and a
    digest of the sequence are compared; the other columns are joined at the end by their order.
    """
    some = F.coalesce(F.col("sequence") != "", F.lit(False))
    copy = F.when(some, F.sha2("sequence", 256)).otherwise(F.concat(F.lit("row "), F.col("seq_order").cast("string")))
    marks = stored(rows.select("seq_order", "sequence_id", "decision", "reasons", copy.alias("copy_")), "marks")
    first = stored(_mark(marks, "copy_", DUPLICATE_SEQUENCE, "duplicate_sequence_of").drop("copy_"), "marks")
    both = _mark(first, "sequence_id", DUPLICATE_ID, "duplicate_id_of")
    return rows.drop("sequence_id", "decision", "reasons").join(both, "seq_order")


def reason_counts(rows: DataFrame) -> DataFrame:
    """``kind, name, n``: records by decision, and reasons of records that are not included."""
    decisions = rows.groupBy(F.col("decision").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("decision").alias("kind"), "name", "n")
    reasons = rows.where("decision != 'include'").select(F.explode("reasons").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return decisions.unionByName(reasons.select(F.lit("reason").alias("kind"), "name", "n"))


def rescue_merge(base: DataFrame, rescued: DataFrame, sequence: str, key: str, route: str) -> DataFrame:
    """Base rows, then rescued ones: those whose sequence is there already are excluded and point to it."""
    known = base.groupBy(F.col(sequence).alias("seq_")).agg(F.min(key).alias("duplicate_sequence_of"))
    merged = rescued.join(known, F.col(sequence) == F.col("seq_"), "left").drop("seq_")
    found = F.col("duplicate_sequence_of").isNotNull()
    merged = merged.withColumn("decision", F.when(found, "exclude").otherwise("include")).withColumn("admission_route", F.when(~found, route))
    kept = base.withColumn("decision", F.lit("include")).withColumn("admission_route", F.lit("strict"))
    return kept.unionByName(merged, allowMissingColumns=True)


def adjudicate(review: DataFrame, official: DataFrame, core: DataFrame, strict: DataFrame, min_length: int, max_length: int) -> DataFrame:
    """Second look at reviewed records: rescue those of fitting length, both profile hits, annotation and legal letters.

    ``official, core, strict`` hold ``sequence_id, score``; the floor is the least strict score. Adds the
    checks, ``profile_decision`` and ``profile_reasons``.
    """
    floor = strict.agg(F.min("score").alias("score_floor"))
    joined = (
        review.join(official.select("sequence_id", F.col("score").alias("official_score")), "sequence_id", "left")
        .join(core.select("sequence_id", F.col("score").alias("core_score")), "sequence_id", "left").crossJoin(F.broadcast(floor))
    )
    checks = {
        f"length_outside_{min_length}_{max_length}": F.length("sequence").between(min_length, max_length),
        "official_profile_failed": F.col("official_score").isNotNull(),
        "below_core_score_floor": F.coalesce(F.col("core_score") >= F.col("score_floor"), F.lit(False)),
        "insufficient_annotation": F.coalesce(F.col("annotation_support"), F.lit(False)),
        "invalid_amino_acids": R.is_legal(F.col("sequence")),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return joined.withColumn("profile_reasons", F.when(F.size(failed) == 0, "passes_profile_review").otherwise(F.array_join(failed, ";"))).withColumn(
        "profile_decision", F.when(F.size(failed) == 0, "rescue").otherwise("exclude")
    )


def join_clusters(rows: DataFrame, maps: dict[str, DataFrame], key: str) -> DataFrame:
    """Adds representative, size and balancing weight for each named map of ``representative, member``."""
    for name, cluster in maps.items():
        # Members are counted before they are shuffled, so a huge cluster is no task of its own.
        sizes = cluster.groupBy(F.col("representative").alias("of_")).agg(F.count(F.lit(1)).alias(f"{name}_size"))
        sized = cluster.join(sizes, F.col("representative").eqNullSafe(F.col("of_"))).select(F.col("member").alias(key), F.col("representative").alias(f"{name}_representative"), f"{name}_size")
        rows = rows.join(sized, key, "left").withColumn(f"{name}_weight", F.round(1 / F.col(f"{name}_size"), 8))
    return rows


def set_relations(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Each key with a flag for every set it is in."""
    out = None
    for name, rows in sets.items():
        flagged = rows.select(key).distinct().withColumn(f"in_{name}", F.lit(True))
        out = flagged if out is None else out.join(flagged, key, "full_outer")
    return out.fillna(False)


def candidates(rows: DataFrame, only: str, ignored: str, checks: dict[str, Column]) -> DataFrame:
    """Rows whose one reason, those that start with ``ignored`` apart, is ``only``; with ``unique_id``, ``unique_sequence`` and each check.

    Sequences are compared by hash and length, so none is shuffled. All is worked out once and stored: a filter on reasons that
    are still an expression would work out every rule, on the whole text, wherever they are named.
    """
    left = F.filter("reasons", lambda r: ~r.startswith(ignored))
    judged = stored(rows.withColumns({**checks, "hash_": F.xxhash64("sequence"), "length_": F.length("sequence"), "only_": left == F.array(F.lit(only))}), "judged")
    found = judged.where("only_").drop("only_")
    ids = found.groupBy(F.col("sequence_id").alias("of_id")).agg((F.count(F.lit(1)) == 1).alias("unique_id"))
    texts = found.groupBy(F.col("hash_").alias("of_hash"), F.col("length_").alias("of_length")).agg((F.count(F.lit(1)) == 1).alias("unique_sequence"))
    joined = found.join(ids, F.col("sequence_id") == F.col("of_id")).join(texts, (F.col("hash_") == F.col("of_hash")) & (F.col("length_") == F.col("of_length")))
    return joined.drop("of_id", "of_hash", "of_length", "hash_", "length_")


def map_problems(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``key, problem``: records that a cluster map does not name (missing) and members that are no record (extra)."""
    ids, named = rows.select(key).distinct(), members.select(F.col("member").alias(key)).distinct()
    return ids.join(named, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(named.join(ids, key, "left_anti").withColumn("problem", F.lit("extra")))


#: Fixed names of what ``id_set_checks`` finds.
NOT_IN, REPEATED_ID, REPEATED_SEQUENCE, NOT_DEGAPPED, ILLEGAL, BAD_LENGTH = "not_in_", "repeated_id", "repeated_sequence", "msa_sequence_differs", "illegal_letters", "length"
ID_SETS = ("fasta", "msa", "metadata", "profile")


def id_set_checks(fasta: DataFrame, alignment: DataFrame, metadata: DataFrame, profile: DataFrame, key: str, seq: str, aligned: str, least: int, most: int) -> DataFrame:
    """``key, violations``: every id that breaks a rule of a dataset to be frozen, with the names of what is wrong, sorted.

    The four sets must hold the same ids, each sequence id once; no other id may have the same sequence; a sequence must be its aligned row without
    gaps, legal, and of a length in the limits. All sources are one tagged union, reduced once by id; sequences meet by digest in a second, small
    reduction. Null ids belong to no set. No rows mean that the sets are sound.
    """
    none = F.lit(None).cast("string")

    def tagged(rows: DataFrame, name: str, sequence: Column, row: Column) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lit(name).alias("set"), sequence.alias("s"), row.alias("a"))

    every = tagged(fasta, "fasta", F.coalesce(seq, F.lit("")), none).unionByName(tagged(alignment, "msa", none, F.replace(aligned, F.lit("-"))))
    every = every.unionByName(tagged(metadata, "metadata", none, none)).unionByName(tagged(profile, "profile", none, none))
    by_id = every.groupBy("id").agg(*[F.count_if(F.col("set") == n).alias(f"in_{n}") for n in ID_SETS], F.max("s").alias("s"), F.max("a").alias("a"))
    # Of one sequence all ids but the first repeat it.
    owners = every.where("set = 'fasta' AND s != ''").groupBy(F.sha2("s", 256).alias("digest")).agg(F.min("id").alias("owner"), F.count_distinct("id").alias("ids")).where("ids > 1")
    joined = by_id.join(owners, F.sha2("s", 256) == F.col("digest"), "left")
    rules = [F.when(F.col(f"in_{n}") == 0, NOT_IN + n) for n in ID_SETS]
    rules += [F.when(F.col("in_fasta") > 1, REPEATED_ID), F.when(F.col("id") != F.col("owner"), REPEATED_SEQUENCE), F.when(F.col("s") != F.col("a"), NOT_DEGAPPED)]
    rules += [F.when(~R.is_legal(F.col("s")), ILLEGAL), F.when(~F.length("s").between(least, most), BAD_LENGTH)]
    found = F.array_sort(F.array_compact(F.array(*rules)))
    return joined.select(F.col("id").alias(key), F.array_join(found, ";").alias("violations")).where("violations != ''")
