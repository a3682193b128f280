"""Salted hashes and identifiers as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
#: Fixed value: the least bytes of a salt.
LEAST_SALT_BYTES = 16


def salt_of(digits: str) -> bytes:
    """A salt from its hexadecimal digits; one that is no hexadecimal or too short is refused."""
    salt = bytes.fromhex(digits.strip())
    if len(salt) < LEAST_SALT_BYTES:
        raise ValueError(f"a salt has to have {LEAST_SALT_BYTES} bytes or more")
    return salt


def submission_id() -> Column:
    """A new submission's name: 'sub_' and 24 random hexadecimal digits."""
    return F.concat(F.lit("sub_"), F.substring(F.translate(F.uuid(), "-", ""), 1, 24))


def _pads(salt: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha256(salt).digest() if len(salt) > BLOCK else salt
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def _literal(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def hmac_sha256(value: Column, salt: bytes) -> Column:
    """Hex HMAC-SHA256 of a string's UTF-8 bytes, from two plain SHA-256 calls."""
    inner, outer = _pads(salt)
    first = F.sha2(F.concat(_literal(inner), value.cast("binary")), 256)
    return F.sha2(F.concat(_literal(outer), F.unhex(first)), 256)


def salted(value: Column, salt: bytes) -> Column:
    """'sha256:' and the HMAC of a string; an empty string stays empty, null stays null."""
    return F.when(value == "", F.lit("")).otherwise(F.concat(F.lit("sha256:"), hmac_sha256(value, salt)))


def salted_json(raw: Column, salt: bytes) -> Column:
    """The salted hash of raw JSON text as it stands; missing and null values hash to ''."""
    return F.when(F.coalesce(raw, F.lit("null")).isin("", "null"), F.lit("")).otherwise(salted(raw, salt))


def salted_list(values: Column, salt: bytes) -> Column:
    """The salted hash of the JSON array of the values' own salted hashes; '' for no values."""
    hashes = F.transform(values, lambda v: salted(v, salt))
    return F.when(F.size(values) > 0, salted(F.to_json(hashes), salt)).otherwise(F.lit(""))


def _joined(*parts: Column) -> Column:
    zero = _literal(b"\0")
    out: list[Column] = []
    for k, p in enumerate(parts):
        out += ([zero] if k else []) + [F.coalesce(p, F.lit("")).cast("binary")]
    return F.concat(*out)


def session_task_id(salt: bytes, remote: Column, session: Column) -> Column:
    """The local identifier of a session: salt, remote and session id, hashed with a zero byte between the last two."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(_literal(salt), _joined(remote, session)), 256))


def corpus_task_id(remote: Column, base_commit: Column, first_prompt: Column) -> Column:
    """The publishable identifier of a task: remote, base commit and first prompt between zero bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(_joined(remote, base_commit, first_prompt), 256))


def short_task_id(task_id: Column) -> Column:
    return F.concat(F.lit("task-"), F.substring(F.regexp_replace(task_id, "^sha256:", ""), 1, 16))


def payload_hash(*columns: str) -> Column:
    """A row's key for idempotent writes: SHA-256 of its JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
