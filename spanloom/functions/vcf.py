"""Variant text: INFO fields, record lines, headers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filters with their descriptions, and INFO fields with number, type and description.
FILTERS = {
    "SMALL": "Insertion smaller than the least size",
    "ALT_SHORTER_THAN_REF": "The inserted sequence is not longer than what it replaces",
    "ANOMALOUS_DEPTH": "Depth beside the insertion is outside of the usual range",
    "HOMOPOLYMER_INSSEQ": "The inserted sequence is a homopolymer",
    "ANOMALOUS_SC_NUMBER": "More clipped reads than the largest usual depth",
    "NO_DISC_SUPPORT": "No discordant pair supports the insertion",
    "LOW_SUPPORT": "Support on both sides is low for the depth",
    "LOW_SCORE": "Most evidence is against the insertion",
    "NOT_ENOUGH_DISC_PAIRS": "Fewer discordant pairs than expected for the size",
    "MH_TOO_LONG": "The microhomology is too long",
    "LOW_QUAL_ASSEMBLY": "The assembled halves are short",
}
INFO = {
    "END": ("1", "Integer", "End position"),
    "SVTYPE": ("1", "String", "Type of variant"),
    "SVLEN": ("1", "Integer", "Difference in length"),
    "SVINSLEN": ("1", "Integer", "Length of the inserted sequence"),
    "SVINSSEQ": ("1", "String", "Inserted sequence"),
    "SPLIT_READS": ("2", "Integer", "Clipped reads left and right"),
    "FWD_SPLIT_READS": ("2", "Integer", "Forward clipped reads left and right"),
    "REV_SPLIT_READS": ("2", "Integer", "Reverse clipped reads left and right"),
    "DISCORDANT": ("2", "Integer", "Discordant pairs left and right"),
    "OVERLAP": ("1", "Integer", "Overlap of the two consensuses"),
    "ALGORITHM": ("1", "String", "How the insertion was found"),
    "LEFT_ANCHOR": ("1", "String", "Stretch left of the insertion"),
    "RIGHT_ANCHOR": ("1", "String", "Stretch right of the insertion"),
    "LEFT_ANCHOR_CIGAR": ("1", "String", "CIGAR of the left anchor"),
    "RIGHT_ANCHOR_CIGAR": ("1", "String", "CIGAR of the right anchor"),
    "AVG_STABLE_NM": ("2", "Float", "Mean edit distance of stable reads left and right"),
    "TRANS_QUERY_COV": ("2", "Integer", "Covered prefix and suffix of the inserted sequence"),
    "STABLE_DEPTHS": ("2", "Integer", "Median depth left and right"),
    "SPANNING_READS": ("2", "Integer", "Pairs that span the left and right breakpoint"),
    "SCORES": ("2", "Float", "Share of evidence left and right"),
    "MHLEN": ("1", "Integer", "Length of the microhomology"),
    "IMPRECISE": ("0", "Flag", "Breakpoints are not exact"),
    "INCOMPLETE_ASSEMBLY": ("0", "Flag", "The inserted sequence is not complete"),
}


def info_map(text: Column) -> Column:
    """map<string, string> of `;`-separated key=value pairs; flags have null values, `.` is empty."""
    return F.when(text.isNull() | (text == "."), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(";"), F.lit("=")))


def info_text(values: dict[str, Column], flags: set[str]) -> Column:
    """Null values and flags that do not hold are left out."""
    parts = [F.when(c, F.lit(k)) if k in flags else F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in values.items()]
    return F.concat_ws(";", *parts)


def record_line(contig: Column, start: Column, name: Column, ref: Column, alt: Column, filter_: Column, info: dict[str, Column], flags: set[str]) -> Column:
    """One line of a file with a single sample; start is 0-based."""
    return F.concat_ws("\t", contig, (start + 1).cast("string"), name, ref, alt, F.lit("."), F.array_join(filter_, ";"), info_text(info, flags), F.lit("GT"), F.lit("1"))


def sv_end(info: Column, pos: Column) -> Column:
    """0-based end: END - 1, else pos + abs(SVLEN); an error without either."""
    end = F.try_element_at(info, F.lit("END")).cast("long") - 1
    length = F.abs(F.try_element_at(info, F.lit("SVLEN")).cast("long"))
    return F.coalesce(end, pos + length, F.raise_error(F.lit("a record has neither END nor SVLEN")).cast("long"))


def inserted_sequence(info: Column, alt: Column) -> Column:
    """The ALT allele if it is spelt out, else SVINSSEQ, else empty."""
    spelt = ~alt.startswith("<") & (F.length(alt) > 1)
    return F.when(spelt, F.substring(alt, 2, 1 << 30)).otherwise(F.coalesce(F.try_element_at(info, F.lit("SVINSSEQ")), F.lit("")))


def header(contigs: list[tuple[str, int]], sample: str, command: str = "", day: date | None = None) -> list[str]:
    """Header lines; contigs in the order of the reference."""
    lines = ["##fileformat=VCFv4.2", f"##fileDate={(day or date.today()):%Y%m%d}"]
    lines += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    lines += ['##ALT=<ID=INS,Description="Insertion">', '##FILTER=<ID=PASS,Description="All filters passed">']
    lines += [f'##FILTER=<ID={k},Description="{d}">' for k, d in FILTERS.items()]
    lines += [f'##INFO=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in INFO.items()]
    lines += ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    lines += [f"##command={command}"] if command else []
    return [*lines, "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]
