"""Page thresholds of journals and scan modes: a small table that the caller may replace."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Pixels. Even and odd pages are printed with mirrored margins."""

    bottom_margin_min: float = 1605.0
    bottom_margin_max: float = 1695.0
    left_margin_threshold_even: float = 195.0
    left_margin_threshold_odd: float = 295.0
    width_threshold_even: float = 1040.0
    width_threshold_odd: float = 1140.0
    merge_footnotes_threshold_even: float = 1050.0
    merge_footnotes_threshold_odd: float = 1120.0
    footnotes_split_threshold_even: float = 1050.0
    footnotes_split_threshold_odd: float = 1150.0
    total_left: float = 7400.0

    def with_(self, **changes: float) -> Thresholds:
        return replace(self, **changes)


#: Thresholds of each journal and mode, in the order of the fields above. The
#: margins of leshonenu exclude each other, so its footnotes never go on on the next page.
JOURNALS = {
    ("tarbiz", "printed"): (1605, 1670, 195, 295, 1070, 1160, 1050, 1080, 1070, 1180, 7200),
    ("tarbiz", "scanned"): (1605, 1695, 195, 195, 1095, 1095, 1070, 1070, 1085, 1085, 7200),
    ("meghillot", "printed"): (1670, 1680, 220, 220, 1027, 1027, 1027, 1140, 1080, 1150, 6700),
    ("meghillot", "scanned"): (1670, 1680, 220, 220, 1027, 1027, 1027, 1027, 1050, 1050, 6700),
    ("shenmishivri", "printed"): (1645, 1685, 205, 205, 1075, 1075, 1045, 1045, 1055, 1055, 7000),
    ("shenmishivri", "scanned"): (1645, 1685, 205, 205, 1075, 1075, 1045, 1045, 1055, 1055, 7000),
    ("sibra", "printed"): (1680, 1712, 195, 295, 1090, 1090, 1050, 1140, 1080, 1150, 7200),
    ("sibra", "scanned"): (1680, 1712, 195, 195, 1090, 1090, 1070, 1070, 1080, 1080, 7200),
    ("zion", "printed"): (1680, 1698, 225, 225, 1080, 1080, 1050, 1140, 1080, 1150, 7200),
    ("zion", "scanned"): (1680, 1698, 225, 225, 1080, 1080, 1070, 1070, 1080, 1080, 7200),
    ("leshonenu", "printed"): (1680, 1665, 220, 220, 1077, 1077, 1050, 1140, 1080, 1150, 7200),
    ("leshonenu", "scanned"): (1680, 1665, 220, 220, 1077, 1077, 1070, 1070, 1080, 1080, 7200),
}

#: Other spellings of journals, what file names call them, and phrases that a
#: paragraph of text does not hold.
ALIASES = {"sidra": "sibra", "lecohotenu": "leshonenu"}
JOURNAL_NAMES = [("leshonenu", "Leshonenu"), ("meghillot", "Meghillot"), ("shenmishivri", "Shenmishivri"), ("sidra", "Sidra"), ("tarbiz", "Tarbiz"), ("zion", "Zion")]
EXCLUDED = ("https://about,jstor.org/terms", "[תרביץ", "(תרביץ", "https://about.jstor.org/terms", "https://aboutjstor.org/terms")


def thresholds(journal: str, mode: str) -> Thresholds:
    """Of a journal and mode; the defaults for an unknown one."""
    row = JOURNALS.get((ALIASES.get(journal, journal), mode))
    return Thresholds(*map(float, row)) if row else Thresholds()


def config_table(spark: SparkSession, rows: dict[tuple[str, str], Thresholds] | None = None) -> DataFrame:
    """(journal, mode, thresholds...): one row for each pair; aliases get rows of their own."""
    rows = {k: thresholds(*k) for k in JOURNALS} if rows is None else rows
    full = dict(rows)
    for alias, name in ALIASES.items():
        full |= {(alias, mode): t for (journal, mode), t in rows.items() if journal == name and (alias, mode) not in rows}
    columns = list(asdict(Thresholds()))
    data = [(j, m, *(float(asdict(t)[c]) for c in columns)) for (j, m), t in sorted(full.items())]
    return spark.createDataFrame(data, "journal string, mode string, " + ", ".join(f"{c} double" for c in columns))


def with_thresholds(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with journal and mode get their thresholds as columns, the defaults where the table
    has none. The table has a row for each journal and mode and is broadcast."""
    out = df.join(F.broadcast(table), ["journal", "mode"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(float(v))) for c, v in asdict(Thresholds()).items()})
