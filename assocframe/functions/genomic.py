"""Variant keys and alleles as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normal_chr(c: Column) -> Column:
    t = F.upper(F.regexp_replace(F.trim(c), "(?i)chr", ""))
    return F.when(t == "23", "X").when(t == "24", "Y").when(t.isin("25", "M", "MT"), "MT").otherwise(t)


def normal_pos(c: Column) -> Column:
    """A position as a long; thousands separators and a fraction of zeros are
    read, anything not positive is null."""
    v = F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")
    return F.when((v >= 1) & (v < 1e18), v.cast("long"))


def normal_allele(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(~t.isin("", "NAN", "NA", "N/A", "NONE", "NULL", ".", "-"), t)


def normal_rsid(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.startswith("rs"), t)


def chrpos(chrom: Column, pos: Column) -> Column:
    return F.when(chrom.isNotNull() & pos.isNotNull() & (chrom != ""), F.concat_ws(":", chrom, pos))


def complement(a: Column) -> Column:
    return F.when(a.rlike("^[ACGT]$"), F.translate(a, "ACGT", "TGCA"))


def is_palindromic(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("/"), b).isin("A/T", "T/A", "C/G", "G/C")


def sorted_pair(a: Column, b: Column) -> Column:
    """Both alleles in order; neither may be null, as least() skips nulls."""
    return F.concat(F.least(a, b), F.lit("/"), F.greatest(a, b))


def canonical_pair(a: Column, b: Column) -> Column:
    """Sorted alleles, of either strand the smaller."""
    direct, ca, cb = sorted_pair(a, b), complement(a), complement(b)
    return F.when(ca.isNull() | cb.isNull(), direct).otherwise(F.least(direct, sorted_pair(ca, cb)))


def match_status(ea: Column, nea: Column, a1: Column, a2: Column) -> Column:
    """How two variants' alleles agree: seven labels. Ambiguity is tested first."""
    ce, cn = complement(ea), complement(nea)
    return (
        F.when(ea.isNull() | nea.isNull() | a1.isNull() | a2.isNull(), "missing_allele")
        .when(is_palindromic(ea, nea) & (sorted_pair(ea, nea) == sorted_pair(a1, a2)), "palindromic_ambiguous")
        .when((ea == a1) & (nea == a2), "direct_match")
        .when((ea == a2) & (nea == a1), "flip_match")
        .when((ce == a1) & (cn == a2), "strand_match")
        .when((ce == a2) & (cn == a1), "strand_flip_match")
        .otherwise("mismatch")
    )


def orientation(ea: Column, nea: Column, a1: Column, a2: Column) -> Column:
    """Same, flipped or mismatch: neither strands nor ambiguity."""
    return F.when((ea == a1) & (nea == a2), "same").when((ea == a2) & (nea == a1), "flipped").otherwise("mismatch")


def build_name(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.rlike("hg19|grch37|b37|build37|(^|[^0-9])37([^0-9]|$)"), "hg19").when(t.rlike("hg38|grch38|b38|build38|(^|[^0-9])38([^0-9]|$)"), "hg38").otherwise("unknown")
