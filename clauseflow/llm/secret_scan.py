"""Secret scans by novelty under a primed compressor.

A candidate is a run of MIN_LENGTH or more signs that keys and tokens are made of, near a word of sensitive context (before it, on the
same line or the one before, or before the line that it continues, as in key blocks).  Its novelty is what it costs a zstandard compressor in bytes, beyond what an empty input
costs, when the compressor is primed with the identifiers of programs, the vocabulary of sensitive contexts, and the text around the candidate (without the candidate
itself, wherever it stands).  A name, a path or a placeholder is made of what the dictionary or the text around has, and costs
little; a random string costs nearly its entropy.  A candidate is reported if its novelty comes to enough bits a sign, and if
its signs aren't plain words.

Only runs next to sensitive context are compressed; finding them is one vectorised pass over each text, without a shuffle.

Defined results: null and empty texts have no candidates; a secret that occurs several times in a text is reported at each place;
repeated rows give repeated reports; a novelty equal to the bound is reported; a null doc_id is carried; texts of any length are read whole, a candidate of any
length is compressed whole; further columns are ignored; an empty table gives no rows.  The secret itself isn't returned: only where it is, how
long, and the start of its SHA-256.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import bytescan as bs
from .common import narrowed, pieces

MIN_LENGTH, AROUND, BEFORE, BITS_A_SIGN, LEVEL = 16, 2048, 96, 3.2, 3

_TOKEN = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _TOKEN[_lo:_hi] = True
_TOKEN[list(b"+/=_-.~")] = True

CONTEXT = re.compile(
    rb"(?i)(api[ _-]?key|access[ _-]?key|secret|token|passw(?:or)?d|passwort|contrase(?:n|\xc3\xb1)a|mot de passe|pwd|credential|private[ _-]?key|auth(?:orization|entication)?|bearer|client[ _-]?id"
    rb"|session[ _-]?(?:id|key)|signature|encryption[ _-]?key|aws|azure|github|slack|stripe|jwt|ssh-(?:rsa|ed25519)|connection[ _-]?string|\bkey\b)"
)

#: What programs and texts about them are full of; none of it is news.
IDENTIFIERS = " ".join(
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ import from return function class public private static void string integer boolean "
    "const let var def self this null none true false undefined lambda async await yield raise throw catch finally except try else elif while for in not and or "
    "package module require include namespace using struct interface implements extends override virtual final abstract protected default switch case break continue "
    "get set put post delete update insert select create table where order group having join left right inner outer limit offset values into distinct "
    "name value key keys token tokens secret password user username account email address phone number index count size length width height offset start end begin "
    "config configuration settings options parameters arguments environment variable path file filename directory folder root home temp output input result response request "
    "http https www com org net io html json xml yaml csv text application content type header body cookie session client server host port url uri endpoint api v1 v2 "
    "authorization bearer basic authentication credentials access private public certificate signature encryption decrypt encrypt hash digest sha256 sha1 md5 hmac "
    "example sample test testing dummy placeholder changeme your_api_key_here your-token-here insert_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 abcdef0123456789 "
    "production staging development debug release version build deploy docker kubernetes container image registry repository branch commit merge master main "
    "database connection string driver postgres mysql redis mongo amazon aws azure google cloud storage bucket region service lambda queue topic stream "
    "get_value set_value to_string from_string create_user delete_user update_user find_by_id get_by_name is_valid has_next max_length min_length default_value "
    "getValue setValue toString fromString createUser deleteUser updateUser findById getByName isValid hasNext maxLength minLength defaultValue "
    "node_modules site-packages usr local bin share lib include src main java python resources static assets images styles scripts index.html package.json README.md".split()
).encode()


def marginal_bytes(candidate: bytes, around: bytes, identifiers: bytes = IDENTIFIERS) -> int:
    """Bytes that the candidate adds to an empty frame, given the dictionary and the text around it without the candidate."""
    primer = identifiers + b"\n" + around.replace(candidate, b" ")
    c = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return len(c.compress(candidate)) - len(c.compress(b""))


def candidates(data: np.ndarray, offsets: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of maximal runs of key signs, of at least that length."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flag = _TOKEN[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = flag[0], flag[-1]
    np.not_equal(flag[1:], flag[:-1], out=edge[1:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = np.unique(inner[flag[inner] & flag[inner - 1]])  # two texts meet within a run
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    start, end = np.sort(np.append(start, inner)), np.sort(np.append(end, inner))
    long = end - start >= least
    start, end = start[long], end[long]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def assigned_name(run: bytes) -> bytes:
    """What stands in front of the last '=' that isn't padding: the name in name=value without spaces, or nothing."""
    return run.rstrip(b"=").rpartition(b"=")[0]


def trimmed(raw: bytes, lo: int, hi: int) -> tuple[int, int]:
    """Without the assignment in front (name=...) and the punctuation around."""
    part = raw[lo:hi]
    name = assigned_name(part)
    m = re.match(rb"[A-Za-z0-9_.\-]{2,40}=(?==?[^=])", part)
    if CONTEXT.search(name) and len(part) - len(name) - 1 >= MIN_LENGTH:
        lo += len(name) + 1
    elif m and len(part) - m.end() >= MIN_LENGTH:
        lo += m.end()
    while hi > lo and raw[hi - 1] in b".-~":
        hi -= 1
    while lo < hi and raw[lo] in b".-~=":
        lo += 1
    return lo, hi


def looks_spelled(token: bytes) -> bool:
    """Words, numbers or dotted names: no run that mixes letters and digits, and no unusual change of case."""
    parts = [p for p in re.split(rb"[+/=_\-.~]+", token) if p]
    return all(re.fullmatch(rb"[0-9]{1,12}|(?:[A-Z]?[a-z]+)+[0-9]{0,4}|[A-Z]+[0-9]{0,4}", p) for p in parts)


def secrets_in(texts: pa.Array, bits: float = BITS_A_SIGN, identifiers: bytes = IDENTIFIERS) -> Iterator[tuple[int, int, int, str, int, float, str]]:
    """(row, start in bytes, length, context, marginal bytes, bits a sign, fingerprint)."""
    data, offsets = bs.buffer_of(texts)
    row, start, end = candidates(data, offsets)
    if not len(row):
        return
    raw = data.tobytes()
    before = 0
    block: tuple[int, int, bytes] = (-1, 0, b"")  # row, end and context of the secret just reported
    for r, lo, hi in zip(row.tolist(), start.tolist(), end.tolist()):
        first, last = int(offsets[r]), int(offsets[r + 1])
        head = raw[max(first, lo - BEFORE, before) : lo]  # a context belongs to the secret that follows it; names and paths between are part of it
        lines = head.split(b"\n")
        whole = b"\n".join(lines[-2:])
        found = [m.group(1) for m in CONTEXT.finditer(whole)]
        if not found:
            found = [m.group(1) for m in CONTEXT.finditer(assigned_name(raw[lo:hi]))]  # name=value without a space
            if not found and block[0] == r and not raw[block[1] : lo].strip():
                found = [block[2]]  # the next line of a key of many lines
            if not found:
                continue
        end_of_run = hi
        lo, hi = trimmed(raw, lo, hi)
        token = raw[lo:hi]
        if len(token) < MIN_LENGTH or looks_spelled(token):
            continue
        around = raw[max(first, lo - AROUND) : min(last, hi + AROUND)]
        cost = marginal_bytes(token, around, identifiers)
        each = 8 * cost / len(token)
        if each >= bits:
            before, block = end_of_run, (r, end_of_run, found[-1])
            yield r, lo - first, hi - lo, found[-1].decode("utf-8", "replace").lower(), cost, each, hashlib.sha256(token).hexdigest()[:16]


_SCHEMA = "doc_id long, start long, length int, context string, marginal_bytes int, bits_a_sign double, fingerprint string"


def scan_secrets(docs: DataFrame, bits: float = BITS_A_SIGN, identifiers: bytes = IDENTIFIERS) -> DataFrame:
    """A row for each secret in each text."""
    docs = narrowed(docs, doc_id="long", text="string")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 4 << 20):
            found = list(secrets_in(piece.column("text"), bits, identifiers))
            if found:
                rows, *rest = (list(x) for x in zip(*found))
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string())
                names = ["doc_id", "start", "length", "context", "marginal_bytes", "bits_a_sign", "fingerprint"]
                yield pa.record_batch([piece.column("doc_id").take(pa.array(rows)), *(pa.array(x, k) for x, k in zip(rest, kinds))], names=names)

    return docs.mapInArrow(scanned, _SCHEMA)
