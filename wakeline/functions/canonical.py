"""Canonical JSON and the hashes taken over it."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields an entry's hash covers, in the order they are
# written, and the predecessor of a log's first entry.
HASHED_FIELDS = ("actor", "body", "effective_from", "event_type", "prev_hash", "recorded_at", "seq", "subject")
GENESIS = "0" * 64

# What plain text may hold and still be written as it is: printable ASCII
# without the quote and the backslash.
PLAIN = r"^[ !#-\[\]-~]*$"


# The characters JSON spells with a letter instead of a number.
SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unicode_escape(unit: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(unit)), 4, "0"))


def _escape_char(char: Column) -> Column:
    point = F.ascii(char)
    above = point - F.lit(0x10000)
    pair = F.concat(_unicode_escape(F.lit(0xD800) + F.shiftright(above, 10)),
                    _unicode_escape(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
    written = F.when(point > 0xFFFF, pair).when((point < 0x20) | (point > 0x7E), _unicode_escape(point)).otherwise(char)
    for plain, escaped in SHORT_ESCAPES.items():
        written = F.when(char == F.lit(plain), F.lit(escaped)).otherwise(written)
    return written


def json_string(text: Column, plain_only: bool = False) -> Column:
    """
    A JSON string literal in ASCII. Only text with something to escape is
    taken apart; `plain_only` says there can be none.
    """
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    if plain_only:
        return quoted
    escaped = F.array_join(F.transform(F.split(text, ""), _escape_char), "")
    return F.when(text.rlike(PLAIN), quoted).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def canonical_entry(columns: dict[str, Column]) -> Column:
    """The text an entry's hash is taken over: sorted keys, no spaces, ASCII only."""
    pieces = []
    for i, field in enumerate(HASHED_FIELDS):
        value = columns[field]
        written = value.cast("string") if field == "seq" else json_string(value, field == "prev_hash")
        pieces += [F.lit(("{" if i == 0 else ",") + f'"{field}":'), F.coalesce(written, F.lit("null"))]
    return F.concat(*pieces, F.lit("}"))


def event_hash(**overrides: Column) -> Column:
    """SHA-256 of the canonical entry, every field but the hash itself."""
    columns = {f: overrides.get(f, F.col(f)) for f in HASHED_FIELDS}
    return F.sha2(canonical_entry(columns), 256)


def canonical_json(value) -> str:
    """Canonical JSON of one small driver-side document such as a policy table."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
