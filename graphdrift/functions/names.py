"""Column expressions that bring module names and file paths to the form in which they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_name(c: Column) -> Column:
    """Blanks and tabs trimmed at both ends, backslashes read as slashes; null where nothing is left."""
    slashes = F.replace(c, F.lit("\\"), F.lit("/"))
    # trimming a set of characters walks the whole string, so names without a tab take the plain trim
    name = F.when(F.contains(c, F.lit("\t")), F.btrim(slashes, F.lit(" \t"))).otherwise(F.trim(slashes))
    return F.when(name != "", name)


def file_path(c: Column) -> Column:
    """Backslashes read as slashes, one leading './' dropped; null stays null."""
    path = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.when(path.startswith("./"), F.substring(path, 3, 2147483647)).otherwise(path)
