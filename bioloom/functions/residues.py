"""Column functions over protein sequences: built-in Spark expressions on one string column, but for one count of all letters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Alphabets and per-residue tables of the scoring rules.
AMINO = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC = "AVILMFWY"
FOLD_HYDROPHOBIC = "AILMFWV"
AROMATIC = "FWY"
POSITIVE, NEGATIVE = "KRH", "DE"
HELIX, SHEET, TURN = "AELMQKRH", "VITFYW", "NGSDPC"
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
SIZE = {
    "A": 89, "C": 121, "D": 133, "E": 147, "F": 165, "G": 75, "H": 155, "I": 131, "K": 146, "L": 131,
    "M": 149, "N": 132, "P": 115, "Q": 146, "R": 174, "S": 105, "T": 119, "V": 117, "W": 204, "Y": 181,
}
GROUPS = {"hydrophobic": "AVILMFWY", "polar": "STNQ", "positive": "KRH", "negative": "DE", "special": "CGP"}
PROPERTIES = {"hydrophobic": "AVILMFWY", "polar": "STNQ", "basic": "KRH", "acidic": "DE", "special": "CGP", "aromatic": "FWY"}
MOTIFS = {"repeat_variant": "SLAEV|SLAEI|SLA[A-Z]V", "hydrophobic_stretch": "[AILVFM]{8,15}", "charged_patch": "[KRH]{3,}|[DE]{3,}"}
OVERALL_WEIGHTS = {"fold": 0.3, "assembly": 0.3, "conserv": 0.15, "novelty": 0.15, "toxic": 0.1}


def letters(seq: Column) -> Column:
    """The residues as an array; none for an empty sequence."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


@F.pandas_udf(ArrayType(IntegerType()))
def letter_counts(seq: pd.Series) -> pd.Series:
    """How often each residue of ``AMINO`` occurs, in one pass; zeros for null. As built-in functions this is a pass a letter."""
    places = np.frombuffer(AMINO.encode(), np.uint8)
    return pd.Series([np.bincount(np.frombuffer((s or "").encode(), np.uint8), minlength=256)[places].astype(np.int32) for s in seq])


class Counted:
    """A sequence column together with the column of its ``letter_counts``: takes the place of the sequence in the functions below."""

    def __init__(self, seq: Column, counts: Column) -> None:
        self.seq, self.counts = seq, counts


def text_of(seq: Column | Counted) -> Column:
    return seq.seq if isinstance(seq, Counted) else seq


def count_of(seq: Column | Counted, alphabet: str) -> Column:
    if isinstance(seq, Counted):
        return total([seq.counts[AMINO.index(a)] for a in alphabet])
    # One letter is found byte by byte, which is far quicker than looking up every character.
    without = F.replace(seq, F.lit(alphabet)) if len(alphabet) == 1 else F.translate(seq, alphabet, "")
    return F.length(seq) - F.length(without)


def ratio(seq: Column | Counted, alphabet: str) -> Column:
    """Share of residues in ``alphabet``; 0 for an empty sequence."""
    return F.when(F.length(text_of(seq)) > 0, count_of(seq, alphabet) / F.length(text_of(seq))).otherwise(F.lit(0.0))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def is_legal(seq: Column) -> Column:
    return seq.rlike(f"^[{AMINO}]*$")


def illegal_letters(seq: Column) -> Column:
    return F.array_sort(F.array_distinct(letters(F.translate(seq, AMINO, ""))))


def longest_run(seq: Column, alphabet: str) -> Column:
    return F.array_max(F.transform(F.split(seq, f"[^{alphabet}]+"), F.length))


def longest_repeat(seq: Column) -> Column:
    """Longest run of one residue; 1 even for an empty sequence."""
    runs = F.transform(F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), 1), F.length)
    return F.greatest(F.lit(1), F.coalesce(F.array_max(runs), F.lit(1)))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order, in one pass of a look-ahead."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), 1)


def kmer_diversity(seq: Column, k: int = 3) -> Column:
    parts = kmers(seq, k)
    return F.when(F.size(parts) > 0, F.size(F.array_distinct(parts)) / F.size(parts)).otherwise(F.lit(0.0))


def max_frequency(seq: Column | Counted) -> Column:
    """Share of the most common of the twenty residues."""
    return F.when(F.length(text_of(seq)) > 0, F.greatest(*[count_of(seq, a) for a in AMINO]) / F.length(text_of(seq))).otherwise(F.lit(0.0))


def has_tandem(seq: Column, width: int, times: int) -> Column:
    """Whether a word of ``width`` stands ``times`` in a row with at least one residue behind it (the last start is never tested)."""
    return seq.rlike(f"(.{{{width}}})" + r"\1" * (times - 1) + ".")


def passes_hard_filter(seq: Column | Counted) -> Column:
    return (
        F.length(text_of(seq)).between(40, 300) & is_legal(text_of(seq)) & (ratio(seq, HYDROPHOBIC) <= 0.60)
        & ~has_tandem(text_of(seq), 3, 3) & ~has_tandem(text_of(seq), 4, 3) & ~has_tandem(text_of(seq), 5, 3) & (max_frequency(seq) <= 0.30)
    )


def blockiness(seq: Column) -> dict[str, Column]:
    """Longest, mean and number of runs of hydrophobic and other residues."""
    other = "".join(a for a in AMINO if a not in HYDROPHOBIC)
    folded = F.translate(seq, HYDROPHOBIC + other, "H" * len(HYDROPHOBIC) + "P" * len(other))
    sizes = F.transform(F.regexp_extract_all(folded, F.lit("(H+|P+)"), 1), F.length)
    return {"max_block": F.array_max(sizes), "mean_block": F.length(seq) / F.nullif(F.size(sizes), F.lit(0)), "n_blocks": F.size(sizes)}


def mean_hydropathy(seq: Column | Counted) -> Column:
    """Null for an empty sequence."""
    return total([count_of(seq, a) * F.lit(v) for a, v in HYDROPATHY.items()]) / F.nullif(F.length(text_of(seq)), F.lit(0))


def charge(seq: Column | Counted) -> Column:
    return count_of(seq, "KR") + count_of(seq, "H") * 0.5 - count_of(seq, NEGATIVE)


def physicochemical(seq: Column | Counted) -> dict[str, Column]:
    weight = total([count_of(seq, a) * F.lit(v) for a, v in SIZE.items()]) + count_of(F.translate(text_of(seq), AMINO, ""), "BJOUXZ") * 110
    return {
        "length": F.length(text_of(seq)),
        "molecular_weight": weight - 18 * (F.length(text_of(seq)) - 1),
        "charge": charge(seq).cast("int"),
        "hydrophobic_ratio": ratio(seq, HYDROPHOBIC),
        "aromatic_ratio": ratio(seq, AROMATIC),
        "isoelectric_point": 7.0 + 0.3 * (count_of(seq, POSITIVE) - count_of(seq, NEGATIVE)),
    }


def structure_propensity(seq: Column | Counted) -> dict[str, Column]:
    mean = mean_hydropathy(seq)
    disorder = F.when(mean < -0.5, F.least(F.lit(1.0), -mean * 0.3 + F.abs(charge(seq)) / F.length(text_of(seq)))).otherwise(F.lit(0.0))
    return {"helix": ratio(seq, HELIX), "sheet": ratio(seq, SHEET), "turn": ratio(seq, TURN), "disorder": disorder}


def localization(seq: Column | Counted) -> dict[str, Column]:
    h, run = ratio(seq, HYDROPHOBIC), longest_run(text_of(seq), HYDROPHOBIC)
    return {
        "localization": F.when(h > 0.55, "Membrane").when(h > 0.4, "Cytoplasm/Membrane").otherwise("Cytoplasm"),
        "solubility": F.when(h > 0.55, 0.3).when(h > 0.4, 0.7).otherwise(0.9),
        "aggregation": F.when((h > 0.6) | (run > 12), "high").when((h > 0.5) | (run > 8), "moderate").otherwise("low"),
    }


def novelty_score(seq: Column | Counted) -> Column:
    n = F.length(text_of(seq))
    by_length = F.when(n.between(60, 100), 0.3).when(n.between(40, 120), 0.5).otherwise(0.8)
    by_repeat = F.when(has_tandem(text_of(seq), 3, 2), 0.7).otherwise(0.3)
    return F.round(0.4 * by_length + 0.3 * F.least(F.lit(1.0), max_frequency(seq) * 3) + 0.3 * by_repeat, 3)


def fold_score(seq: Column | Counted) -> Column:
    """Without the random jitter that such heuristics sometimes add."""
    n, h = F.length(text_of(seq)), ratio(seq, FOLD_HYDROPHOBIC)
    base = F.when(n.between(60, 160), 0.85).when(n.between(40, 200), 0.70).otherwise(0.50)
    return F.round(F.least(F.lit(0.99), base + F.when(h.between(0.4, 0.6), 0.10).otherwise(0.0)), 2)


def safety_score(seq: Column | Counted) -> Column:
    h, c = ratio(seq, HYDROPHOBIC), ratio(seq, POSITIVE + NEGATIVE)
    solubility = F.when(h.between(0.3, 0.5), 0.85).when(h < 0.3, 0.75).otherwise(F.greatest(F.lit(0.3), 0.9 - h))
    tendency = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (h - c) * 20 + F.length(text_of(seq)) / 100 * 2))
    aggregated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (tendency + 10) / 20))
    return F.least(F.lit(0.99), F.greatest(F.lit(0.0), 0.6 * solubility + 0.4 * (1 - aggregated)))


def assembly_score(seq: Column | Counted) -> Column:
    plus, minus = count_of(seq, POSITIVE), count_of(seq, NEGATIVE)
    balance = 1.0 - F.abs(plus - minus) / F.greatest(plus + minus, F.lit(1))
    score = 0.5 + 0.3 * balance + 0.2 * (1.0 - F.abs(ratio(seq, HYDROPHOBIC) - 0.45) * 2.0)
    return F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.3), score)), 3)


def pair_assembly_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    matched = F.least(count_of(a, POSITIVE), count_of(b, NEGATIVE)) + F.least(count_of(a, NEGATIVE), count_of(b, POSITIVE))
    charges = F.least(F.lit(1.0), matched / longest * 5.0)
    hydro = 1.0 - F.abs(ratio(a, HYDROPHOBIC) - ratio(b, HYDROPHOBIC))
    size = F.least(F.length(a), F.length(b)) / longest
    rings = F.least(F.lit(1.0), (ratio(a, AROMATIC) + ratio(b, AROMATIC)) * 3.0)
    score = 0.35 * charges + 0.30 * hydro + 0.20 * size + 0.15 * rings
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.3), score)), 3)


def overall_score(scores: dict[str, Column]) -> Column:
    return total([F.coalesce(scores[k], F.lit(0.5)) * w for k, w in OVERALL_WEIGHTS.items()])


# Special tokens of the sequence tokenizer; residues follow in the order of AMINO.
PAD, BOS, EOS, UNK = 0, 1, 2, 3


def token_ids(seq: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for i, a in enumerate(AMINO) for x in (a, i + 4)])
    body = F.transform(letters(seq), lambda c: F.coalesce(F.try_element_at(codes, c), F.lit(UNK)))
    return F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS)))


def detokenize(ids: Column) -> Column:
    """Residues of the ids; special tokens go, an unknown id is ``X``."""
    symbols = F.array(*[F.lit(a) for a in AMINO])
    return F.array_join(F.transform(F.filter(ids, lambda i: ~i.isin(PAD, BOS, EOS)), lambda i: F.coalesce(F.get(symbols, i - 4), F.lit("X"))), "")


def normalize_accession(token: Column) -> Column:
    part = F.split(token, r"\|")
    return (
        F.when(part[0].isin("sp", "tr") & (F.size(part) > 1), part[1])
        .when((part[0] == "pdb") & (F.size(part) > 2), F.concat_ws("_", part[1], part[2]))
        .when(part[0] == "pir", F.element_at(part, -1))
        .otherwise(token)
    )
