"""Keys as text whose plain order is the order of the values; for tests and for stores that order by bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sortable(column: Column, kind: str) -> Column:
    """Hex of an order-preserving, self-delimiting form of an Int64, Bool or String column."""
    if kind == "Int64":  # the sign bit flipped
        return F.lpad(F.hex(column.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    if kind == "Bool":
        return F.when(column, "01").otherwise("00")
    if kind == "String":  # NUL is escaped, two of them end the string
        return F.concat(F.array_join(F.transform(F.split(column, "\\x00", -1), F.hex), "00FF"), F.lit("0000"))
    raise ValueError(kind)


# One code of a string: any byte but 00, or the escaped one.
_CODE = "(?:0[1-9A-F]|[1-9A-F][0-9A-F])"


def unsorted_key(column: Column, kinds: list[str]) -> list[Column]:
    """The values of a key that sortable_key() made of columns of these kinds; null where the key is none such."""
    out, rest = [], column
    for kind in kinds:
        if kind == "Int64":
            code, size = F.substring(rest, 1, 16), F.lit(16)
            value = F.conv(code, 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
            value = F.when(code.rlike("^[0-9A-F]{16}$"), value)
        elif kind == "Bool":
            code, size = F.substring(rest, 1, 2), F.lit(2)
            value = F.when(code == "01", F.lit(True)).when(code == "00", F.lit(False))
        elif kind == "String":
            code = F.regexp_extract(rest, f"^((?:{_CODE}|00FF)*)0000", 1)
            size = F.length(code) + 4
            # Each escaped byte is looked for where the last one ended, so that codes stay in step.
            value = F.when(rest.rlike(f"^(?:{_CODE}|00FF)*0000"), F.decode(F.unhex(F.regexp_replace(code, f"\\G((?:{_CODE})*)00FF", "$100")), "UTF-8"))
        else:
            raise ValueError(kind)
        out.append(value)
        rest = F.substr(rest, size + 1)
    return out


def sortable_key(columns: list[tuple[Column, str]]) -> Column:
    """Several columns as one key."""
    return reduce(lambda a, b: F.concat(a, b), [sortable(c, k) for c, k in columns])
