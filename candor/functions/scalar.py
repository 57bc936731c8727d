"""Scalar functions: unknowns, identifiers, dates, vectors, log-factorials."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(df: DataFrame, codes: dict[str, list] | None = None) -> DataFrame:
    """`df` with NaN, and each column's codes for unknown, as null."""
    columns = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), None).otherwise(c)
        if codes and f.name in codes:
            c = F.when(c.isin(codes[f.name]), None).otherwise(c)
        columns[f.name] = c
    return df.withColumns(columns)


def normalised(column: Column, steps: list[str]) -> Column:
    """An identifier after the named steps, in their order."""
    actions = {
        "strip": F.trim,
        "upper": F.upper,
        "lower": F.lower,
        "strip_version": lambda c: F.regexp_replace(c, r"\.\d+$", ""),
        "curie_colon": lambda c: F.regexp_replace(c, r"^([A-Za-z]+)_", "$1:"),
        "curie_underscore": lambda c: F.regexp_replace(c, r"^([A-Za-z]+):", "$1_"),
        "strip_chr": lambda c: F.regexp_replace(c, r"(?i)^chr", ""),
        "separator_to_underscore": lambda c: F.regexp_replace(c, r"[-: ]", "_"),
    }
    for step in steps:
        name, _, arg = step.partition("=")
        if name == "strip_prefix":
            column = F.when(column.startswith(arg), F.substr(column, F.lit(len(arg) + 1))).otherwise(column)
        elif name == "strip_suffix":
            column = F.when(column.endswith(arg), F.left(column, F.length(column) - len(arg))).otherwise(column)
        elif name == "canonical_prefix_case":
            column = F.when(F.lower(F.left(column, F.lit(len(arg)))) == arg.lower(), F.concat(F.lit(arg), F.substr(column, F.lit(len(arg) + 1)))).otherwise(column)
        else:
            column = actions[name](column)
    return column


# The forms of the public identifiers that the catalog knows.
IDENTIFIERS = {
    "cellosaurus": r"^CVCL_[A-Z0-9]{4}$",
    "census_joinid": r"^(?:0|[1-9]\d*)$",
    "cell_barcode": r"^[ACGTN]{8,}(?:-\d+)?$",
    "census_feature": r"^ENSG\d{11}$",
    "chembl_molecule": r"^CHEMBL\d+$",
    "chromosome": r"^(?:[1-9]|1\d|2[0-2]|X|Y|MT)$",
    "depmap_cell_line": r"^ACH-\d{6}$",
    "doi": r"^10\.\d{4,9}/\S+$",
    "drug_name": r"^\S(?:[^\t\r\n]*\S)?$",
    "ensembl_gene": r"^ENSG\d{11}$",
    "ensembl_gene_mouse": r"^ENSMUSG\d{11}$",
    "ensembl_gene_any": r"^ENS[A-Z]*G\d{11}$",
    "europepmc_ppr": r"^PPR\d+$",
    "geo_gsm": r"^GSM\d+$",
    "go": r"^GO:\d{7}$",
    "hgnc_symbol": r"^[A-Za-z0-9][A-Za-z0-9._@/#\-]*$",
    "hpo": r"^HP_\d{7}$",
    "inchikey": r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$",
    "ncbi_taxon": r"^[1-9]\d*$",
    "ncbi_gene": r"^[1-9]\d*$",
    "nct_id": r"^NCT\d{8}$",
    "cell_ontology": r"^CL:\d{7}$",
    "uberon": r"^UBERON:\d{7}$",
    "disease_name": r"^\S(?:[^\t\r\n]*\S)?$",
    "pmcid": r"^PMC\d+$",
    "pmid": r"^[1-9]\d{0,8}$",
    "reactome": r"^R-[A-Z]{3}-\d+$",
    "rsid": r"^rs\d+$",
    "so": r"^SO:\d{7}$",
    "study_locus_id": r"^[0-9a-f]{32}$",
    "cbio_cancer_type": r"^[a-z0-9][a-z0-9_\-]*$",
    "cbio_study": r"^[a-z0-9][a-z0-9_\-]*$",
    "cbio_sample": r"^(?:TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-\d{2}[A-Z]?|\S+)$",
    "cbio_patient": r"^(?:TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}|\S+)$",
    "europepmc_id": r"^(?:[1-9]\d{0,8}|(?:PPR|PMC|IND|CAIN|FNI|c)\d+)$",
    "ot_disease": r"^(?:EFO|MONDO|HP|Orphanet|DOID|GO|OBA|OTAR|NCIT|MP)_\w+$",
    "gwas_study": r"^(?:GCST\d+(?:_\d+)?|FINNGEN_R\d+_\S+|NEALE2_\S+|SAIGE_\S+)$",
    "tahoe_drug": r"^\S(?:[^\t\r\n]*\S)?$",
    "tahoe_gene_name": r"^(?:ENSG\d{11}|[A-Za-z0-9][A-Za-z0-9._@/#\-]*)$",
    "uniprot_accession": r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$",
    "ot_variant": r"^(?:[1-9]|1\d|2[0-2]|X|Y|MT)_\d+_[ACGTN]+_[ACGTN]+$",
}


def is_kind(column: Column, kind: str) -> Column:
    """Whether an identifier has the form of its kind."""
    return column.rlike(IDENTIFIERS[kind])


def latest_day(column: Column) -> Column:
    """The last day a written date can mean: YYYY, YYYY-MM, YYYY-MM-DD (with or without a time), "Month YYYY" or "Month D, YYYY"; null if it is none."""
    return F.coalesce(
        F.when(column.rlike(r"^\d{4}$"), F.try_to_date(F.concat(column, F.lit("-12-31")))),
        F.when(column.rlike(r"^\d{4}-\d{2}$"), F.last_day(F.try_to_date(F.concat(column, F.lit("-01"))))),
        F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), F.try_to_date(F.left(column, F.lit(10)))),
        F.when(column.rlike(r"^[A-Za-z]+ \d{4}$"), F.last_day(F.try_to_date(F.concat(F.lit("1 "), _month(column)), "d MMMM yyyy"))),
        F.when(column.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), F.try_to_date(_month(column), "MMMM d, yyyy")),
    )


def earliest_day(column: Column) -> Column:
    """The first day a written date can mean, of the same forms as `latest_day`."""
    last = latest_day(column)
    return F.when(column.rlike(r"^\d{4}$"), F.trunc(last, "year")).when(column.rlike(r"^\d{4}-\d{2}$|^[A-Za-z]+ \d{4}$"), F.trunc(last, "month")).otherwise(last)


def _month(column: Column) -> Column:
    return F.initcap(column)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """Null where either norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(k: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    """P(X >= k) for draws without replacement, by log-factorials."""
    from math import exp, lgamma

    def choose(n: int, r: int) -> float:
        return lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)

    def tail(k: int, n: int, m: int, t: int) -> float:
        low, high = max(k, n + m - t, 0), min(n, m)
        return min(1.0, sum(exp(choose(m, i) + choose(t - m, n - i) - choose(t, n)) for i in range(low, high + 1))) if k > 0 else 1.0

    return pd.Series([tail(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, drawn, marked, total)])


def phase_number(column: Column) -> Column:
    """A written trial phase as a number: "EARLY" alone or 0 is 0.5, Roman or Arabic 1 to 4 with halves, the greatest of a combined one; else null."""
    text = F.upper(column)
    arabic = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9.])([0-4](?:\.5)?)"), F.lit(1)), lambda x: F.when(x == "0", 0.5).otherwise(x.cast("double")))
    roman = F.transform(F.regexp_extract_all(text, F.lit(r"\b(IV|I{1,3})\b"), F.lit(1)), lambda x: F.array_position(F.array(*map(F.lit, ("I", "II", "III", "IV"))), x).cast("double"))
    found = F.array_max(F.concat(arabic, roman))
    return F.when(text.contains("EARLY") & (F.coalesce(found, F.lit(1.0)) <= 1), F.lit(0.5)).otherwise(found)


def squeezed(share: Column, n: Column) -> Column:
    """A proportion of n moved off 0 and 1."""
    return F.try_divide(share * (n - 1) + 0.5, n)


def below(mantissa: str, exponent: str, m: float, e: int) -> Column:
    """mantissa * 10^exponent < m * 10^e for normalised positive numbers, without the arithmetic that underflows."""
    return (F.col(exponent) < e) | ((F.col(exponent) == e) & (F.col(mantissa) < m))
