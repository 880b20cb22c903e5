"""place label from name, admin2, admin1 and country, skipping blanks and repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def place_label(name: Column, admin1: Column, admin2: Column, country: Column) -> Column:
    part2 = F.when(_present(admin2) & (admin2 != name), admin2)
    # admin1 is compared with admin2 even when admin2 itself was skipped.
    part1 = F.when(_present(admin1) & ~admin1.eqNullSafe(admin2) & (admin1 != name), admin1)
    part_c = F.when(_present(country), country)
    return F.concat_ws(", ", name, part2, part1, part_c)
