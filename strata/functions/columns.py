"""Scalar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens that mean "missing" in the survey sheets.
MISSING_TOKENS = ("", "nan", "NA", "N/A")

# Ordinal vote range.
CLASS_MIN, CLASS_MAX = -3, 3


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def clean_numeric_string(c) -> Column:
    """trim, remove every blank inside, map missing tokens to null."""
    s = F.regexp_replace(F.trim(col(c).cast("string")), " ", "")
    return F.when(s.isin(*MISSING_TOKENS), F.lit(None).cast("string")).otherwise(s)


def to_numeric(c) -> Column:
    """coerce to double; unparsable -> null, NaN -> null."""
    return nan_to_null(F.expr("try_cast({} AS DOUBLE)".format(_sql_ident(c))) if isinstance(c, str)
                       else col(c).try_cast("double"))


def to_class(c) -> Column:
    """clip to [-3, 3] and round half to even, as integer class."""
    x = col(c).cast("double")
    clipped = F.greatest(F.lit(float(CLASS_MIN)), F.least(F.lit(float(CLASS_MAX)), x))
    return F.bround(clipped, 0).cast("int")


def classify3(c) -> Column:
    """Cool / Neutral / Warm after class rounding and clipping."""
    v = to_class(c).cast("double")
    return (F.when(v < -0.5, F.lit("Cool"))
            .when(v < 0.5, F.lit("Neutral"))
            .otherwise(F.lit("Warm")))


def clip(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(c)))


def r6(c, places: int = 6) -> Column:
    """Report rounding: ``round(x * 10^p) / 10^p`` in double arithmetic, half away from
    zero, sign of zero kept -- the same bits a C-style ``round(x, p)`` gives, so report
    values compare exactly across engines."""
    x = col(c).cast("double")
    scale = float(10 ** places)
    r = F.round(x * F.lit(scale), 0) / F.lit(scale)
    return F.when((x < 0) & (r == 0), F.lit(-0.0)).otherwise(r)


def safe_suffix(value: str) -> str:
    """Column-name suffix used for interactions: blanks and '/' become '_'."""
    return str(value).replace(" ", "_").replace("/", "_")


def norm_name(name: str) -> str:
    """The letters and digits of a column name, in lower case."""
    return "".join(ch for ch in str(name).lower() if ch.isalnum())


def _sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def round_doubles(df, places: int = 6):
    """Round every double column of a report frame."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(r6(F.col(_sql_ident(f.name)), places).alias(f.name))
        else:
            out.append(F.col(_sql_ident(f.name)))
    return df.select(*out)
