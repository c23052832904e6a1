"""Column functions over sequence headers and file names: tags, trailing organisms, species and chains."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Prefixes of databases whose ids name a protein and a species, and of those that name neither; the family in names of chains.
NAMED_PREFIXES, PLAIN_PREFIXES, FAMILY = ("sp|", "tr|"), ("WP_", "YP_"), "GVP"
UNKNOWN = "unknown"


def tags(description: Column) -> Column:
    """All words ``name=value`` of a description, in order, as an array of ``name, value``; a word without a name is none."""
    words = F.filter(F.split(description, r"\s+"), lambda w: F.locate("=", w) > 1)
    return F.transform(words, _split)


def _split(word: Column) -> Column:
    at = F.locate("=", word)
    return F.struct(word.substr(F.lit(1), at - 1).alias("name"), word.substr(at + 1, F.length(word)).alias("value"))


def tag(description: Column, name: str) -> Column:
    """The value of the first tag of this name; null without one."""
    return F.get(F.filter(tags(description), lambda t: t["name"] == name), 0)["value"]


def trailing_organism(header: Column) -> Column:
    """What stands in the last square brackets at the end of a header, trimmed; empty without them."""
    return F.trim(F.regexp_extract(header, r"\[([^\[\]]+)\]\s*$", 1))


def _starts(header: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | header.startswith(p)
    return found


def species(header: Column) -> Column:
    """The species in a header: after the last underscore of a named entry, none for accessions, else all after the first underscore."""
    entry = F.split(F.element_at(F.split(header, r"\|"), -1), "_")
    own = F.when(F.size(entry) > 1, F.element_at(entry, -1)).otherwise(UNKNOWN)
    other = F.when(F.locate("_", header) > 0, header.substr(F.locate("_", header) + 1, F.length(header))).otherwise(UNKNOWN)
    return F.when(_starts(header, NAMED_PREFIXES), own).when(_starts(header, PLAIN_PREFIXES), UNKNOWN).otherwise(other)


def _of_family(name: Column) -> Column:
    """What follows the family's name in the name of a chain, in capitals; null where it is no such name."""
    return F.when(F.upper(name).startswith(FAMILY) & (F.length(name) > len(FAMILY)), F.upper(name.substr(len(FAMILY) + 1, 1 << 20)))


def chain(header: Column, file_name: Column | None = None) -> Column:
    """The chain letters of a record: from the name of its file, else of a named entry (its first letter), else before the first underscore."""
    entry = F.substring_index(F.element_at(F.split(header, r"\|"), -1), "_", 1)
    named = F.when(_starts(header, NAMED_PREFIXES), F.left(_of_family(entry), F.lit(1)))
    found = F.coalesce(named, _of_family(F.substring_index(header, "_", 1)))
    if file_name is None:
        return found
    stem = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(_of_family(stem), found)
