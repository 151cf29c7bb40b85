"""Key columns: spelling-independent uuids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_uuid(text: Column) -> Column:
    """A key with case, hyphens, braces and surrounding blanks removed; null for null, empty or blank text.

    Text that is no uuid keeps its (lower-cased, stripped) characters, so it still only equals itself.
    """
    bare = F.translate(F.lower(text), "{}- \t\n\r", "")
    return F.when(F.length(bare) > 0, bare)


def uuid_key(text: Column) -> Column:
    """``bare_uuid`` as 16 bytes where it is a well-formed uuid, else the bytes of the bare text: half the shuffle volume of the text."""
    return key_bytes(bare_uuid(text))


def key_bytes(bare: Column) -> Column:
    """``uuid_key`` of a column that is bare already."""
    return F.coalesce(F.when(F.length(bare) == 32, F.try_to_binary(bare, F.lit("hex"))), F.encode(bare, "UTF-8"))


def hyphenated(bare: Column) -> Column:
    """A bare uuid in the usual spelling; other text as it is."""
    return F.when(F.length(bare) == 32, F.when(F.translate(bare, "0123456789abcdef", "") == "", F.concat_ws("-", bare.substr(1, 8), bare.substr(9, 4), bare.substr(13, 4), bare.substr(17, 4), bare.substr(21, 12))).otherwise(bare)).otherwise(bare)


def uuid_text(text: Column) -> Column:
    """The usual hyphenated lower-case spelling of a uuid in any spelling; other text is only lower-cased and stripped."""
    return hyphenated(bare_uuid(text))
