"""Secret scans with structural confirmation.

*Base spans* are the leftmost non-overlapping matches of three patterns that
pass a length check; they always stay.

*Structural confirmation* adds spans.  Runs of base64 or hex characters, private
key blocks between their BEGIN and END lines, and dotted tokens are candidates.
A candidate is decoded and parsed, and reported only if its bytes are, from the
first to the last, one of:

* ``key``: a private key.  ASN.1 in definite, shortest-form lengths in which
  every nested value fills its parent exactly: RSA (9 integers), DSA (6), EC,
  PKCS #8 and encrypted PKCS #8; or the OpenSSH format, whose length-prefixed
  fields must fill the blob and whose check numbers must agree.  Text that
  decodes to another encoding of a key (base64 of a PEM file, hex of base64) is
  decoded again, ``DEPTH`` times at most.
* ``token``: a signed or encrypted web token.  Its header decodes to a JSON
  object that names an algorithm, its payload to a JSON object, and its
  signature has that algorithm's length.

Certificates, public keys, random bytes and prose fail the parse and are not
reported.  One pass over each whole text inside Arrow batches: no shuffle, and
memory is bounded by a batch and its longest text.

Edge cases: null text is empty and has no span; spans of different kinds may
overlap or be equal and sort by start, then by kind in the order of ``KINDS``;
repeated rows and null keys get their own rows; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quire.session import ship_package

# Kinds in their order, base patterns, lengths and encodings.
BASE_KINDS = ["assign", "access", "hex"]
KINDS = ["assign", "access", "hex", "key", "token"]
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: bytes of a signature by algorithm; RSA ones are as long as the modulus
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132,
             "EdDSA": 64, "none": 0}
RSA_SIGNATURES = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}
RSA_BYTES = {128, 192, 256, 384, 512, 1024, 2048}
OPENSSH = b"openssh-key-v1\x00"
MIN_CODED = 44   # characters of the shortest key looked for (an Ed25519 key has 64)
MAX_MODULUS = 1 << 15   # bits
DEPTH = 3        # encodings inside encodings

# the letters of ASSIGN are ASCII ones in either case, hence re.ASCII
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)  # a run is one match, so shorter ones may be passed over
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CODED)
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
_HEX_ONLY = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
_TEXTUAL = re.compile(rb"[\x09\x0A\x0D\x20-\x7E]+")


# ---- decoding ----------------------------------------------------------------

def decode_base64(s: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, padded or not; null if ``s`` is
    neither, mixes the two, or leaves bits over."""
    body = s.rstrip("=")
    url, plain = "-" in body or "_" in body, "+" in body or "/" in body
    if not body or (url and plain) or len(body) % 4 == 1 or (len(body) != len(s) and len(s) % 4):
        return None
    if url:
        body = body.translate(str.maketrans("-_", "+/"))
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return data if base64.b64encode(data).rstrip(b"=") == body.encode() else None


def decodings(s: str) -> list[bytes]:
    """What a run of characters may stand for."""
    out = [bytes.fromhex(s)] if _HEX_ONLY.fullmatch(s) else []
    data = decode_base64(s)
    return out if data is None else [*out, data]


# ---- key encodings -----------------------------------------------------------

def der_values(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``data`` exactly; null if a length
    is indefinite, not in its shortest form or beyond the end."""
    out, i, n = [], 0, len(data)
    while i < n:
        if i + 2 > n or data[i] & 0x1F == 0x1F:
            return None
        tag, size, i = data[i], data[i + 1], i + 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or i + more > n:
                return None
            size = int.from_bytes(data[i:i + more], "big")
            if size < 0x80 or size >> (8 * (more - 1)) == 0:
                return None
            i += more
        if i + size > n:
            return None
        out.append((tag, data[i:i + size]))
        i += size
    return out


def _integer(value: tuple[int, bytes]) -> bool:
    """A positive integer in its shortest form."""
    tag, c = value
    return tag == 0x02 and len(c) > 0 and c[0] < 0x80 and not (len(c) > 1 and c[0] == 0 and c[1] < 0x80)


def _number(value: tuple[int, bytes]) -> int:
    return int.from_bytes(value[1], "big") if _integer(value) else -1


def _algorithm(value: tuple[int, bytes]) -> bool:
    """SEQUENCE of an object identifier and at most one parameter."""
    inner = der_values(value[1]) if value[0] == 0x30 else None
    return bool(inner) and len(inner) <= 2 and inner[0][0] == 0x06 and len(inner[0][1]) >= 3


def der_key(data: bytes, wrapped: bool = False) -> bool:
    """Whether ``data`` is one private key in DER; one wrapped in PKCS #8 may
    leave out what its wrapping names."""
    top = der_values(data) if data[:1] == b"\x30" else None
    inside = der_values(top[0][1]) if top and len(top) == 1 else None
    if not inside:
        return False
    tags = [t for t, _ in inside]
    if all(t == 0x02 for t in tags):
        if not all(map(_integer, inside)):
            return False
        numbers = [_number(v) for v in inside]
        if len(numbers) == 9:    # RSA: version, n, e, d, p, q, and three of the remainder theorem
            return (numbers[0] == 0 and 512 <= numbers[1].bit_length() <= MAX_MODULUS
                    and max(numbers[4], numbers[5]) < numbers[1] and numbers[4] * numbers[5] == numbers[1])
        return len(numbers) == 6 and numbers[0] == 0 and numbers[5] < numbers[2] < numbers[1]  # DSA
    if tags[:3] == [0x02, 0x30, 0x04] and _number(inside[0]) in (0, 1) and _algorithm(inside[1]):
        own = der_values(inside[2][1])  # PKCS #8: the algorithm's key, attributes, public key
        return (bool(own) and len(own) == 1 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
                and (own[0][0] in (0x02, 0x04) or der_key(inside[2][1], wrapped=True)))
    if tags[:2] == [0x02, 0x04] and _number(inside[0]) == 1:  # EC
        rest = [der_values(c) if t in (0xA0, 0xA1) else None for t, c in inside[2:]]
        return len(inside[1][1]) >= 16 and int(not wrapped) <= len(rest) <= 2 and all(r and len(r) == 1 for r in rest)
    if tags == [0x30, 0x04] and _algorithm(inside[0]):  # encrypted PKCS #8: parameters are a sequence
        return der_values(inside[0][1])[-1][0] == 0x30 and len(inside[1][1]) >= 32
    return False


def _strings(data: bytes, count: int) -> tuple[list[bytes], bytes] | None:
    """``count`` length-prefixed strings and what follows them."""
    out = []
    for _ in range(count):
        if len(data) < 4:
            return None
        size = int.from_bytes(data[:4], "big")
        if size > len(data) - 4:
            return None
        out.append(data[4:4 + size])
        data = data[4 + size:]
    return out, data


def openssh_key(data: bytes) -> bool:
    """Whether ``data`` is one private key in the OpenSSH format."""
    head = _strings(data[len(OPENSSH):], 3) if data.startswith(OPENSSH) else None
    if head is None or len(head[1]) < 4:
        return False
    (cipher, kdf, _), rest = head
    keys = int.from_bytes(rest[:4], "big")
    if not 1 <= keys <= 16:
        return False
    body = _strings(rest[4:], keys + 1)
    if body is None or body[1] or (cipher == b"none") != (kdf == b"none"):
        return False
    private = body[0][-1]
    return len(private) >= 8 and len(private) % 8 == 0 and (cipher != b"none" or private[:4] == private[4:8])


def holds_key(data: bytes, depth: int = DEPTH) -> bool:
    """Whether bytes are a private key, or text that is an encoding of one."""
    if der_key(data) or openssh_key(data):
        return True
    if depth <= 1 or len(data) < MIN_CODED or not _TEXTUAL.fullmatch(data):
        return False
    text = data.decode("ascii").strip()
    if any(armored_key(body, depth - 1) for _, body, _ in armor(text)):
        return True
    body = "".join(text.split())
    return _RUN.fullmatch(body) is not None and any(holds_key(d, depth - 1) for d in decodings(body))


def armor(text: str):
    """(start, body, stop) of the blocks between matching BEGIN and END lines.  The
    next row of dashes ends a body, so a text is read once."""
    for m in _BEGIN.finditer(text):
        end = f"-----END {m[1]}-----"
        stop = text.find("-----", m.end())
        if stop >= 0 and text.startswith(end, stop):
            yield m.start(), text[m.end():stop], stop + len(end)


def armored_key(body: str, depth: int = DEPTH) -> bool:
    """Whether the lines between BEGIN and END hold a key; headers of an
    encrypted one are skipped and its bytes must be whole cipher blocks."""
    lines = body.replace("\r", "\n").split("\n")
    headers = [x for x in lines if ":" in x]
    data = decode_base64("".join("".join(x.split()) for x in lines if ":" not in x))
    if data is None:
        return False
    if any(x.startswith("DEK-Info:") for x in headers):
        return len(data) >= 32 and len(data) % 8 == 0
    return holds_key(data, depth)


# ---- signed tokens -----------------------------------------------------------

def _object(part: str) -> dict | None:
    """The JSON object that a token's part decodes to."""
    data = decode_base64(part) if "=" not in part else None
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def web_token(parts: list[str]) -> bool:
    """Whether parts are a compact signed (3) or encrypted (5) web token."""
    header = _object(parts[0])
    if header is None or not isinstance(alg := header.get("alg"), str):
        return False
    coded = [decode_base64(p) if p else b"" for p in parts[1:]]
    if "=" in "".join(parts) or None in coded:
        return False
    if len(parts) == 5:
        return isinstance(header.get("enc"), str) and all(coded[1:])
    if len(parts) != 3 or _object(parts[1]) is None:
        return False
    size = len(coded[-1])
    return size in RSA_BYTES if alg in RSA_SIGNATURES else size == SIGNATURE.get(alg, -1)


def token_end(m: re.Match) -> int | None:
    """Where the token at a dotted run ends: five parts, else three."""
    parts = m[0].split(".")
    for n in (5, 3):
        if len(parts) >= n and web_token(parts[:n]):
            return m.start() + len(".".join(parts[:n]))
    return None


# ---- spans -------------------------------------------------------------------

Span = tuple[int, int, int]   # start, rank of the kind, stop


def base_spans(text: str) -> list[Span]:
    low, out = text.lower(), []
    if any(word in low for word in ("password", "passwd", "secret", "token", "api")):
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[Span]:
    """Spans whose bytes parse as a key or a token."""
    blocks = [(a, z) for a, body, z in armor(text) if armored_key(body)]
    out, n = [(a, 3, z) for a, z in blocks], 0
    for m in _RUN.finditer(text):
        while n < len(blocks) and blocks[n][1] <= m.start():
            n += 1
        inside = n < len(blocks) and blocks[n][0] <= m.start()
        if not inside and any(holds_key(d) for d in decodings(m[0])):
            out.append((m.start(), 3, m.end()))
    for m in _TOKEN.finditer(text):
        if (stop := token_end(m)) is not None:
            out.append((m.start(), 4, stop))
    return sorted(out)


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and confirmed ones together."""
    long_word = max(map(len, text.split()), default=0) >= MIN_HEX  # hex, keys and tokens need one
    if not long_word and "PRIVATE KEY" not in text:
        base = [x for x in base_spans(text) if x[1] < 2]
        return base, base
    base = base_spans(text)
    return base, sorted(base + confirmed_spans(text))


SPANS = "array<struct<start:int,stop:int,kind:string>>"


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, base (array of start, stop, kind, by start then kind)
    and spans (base and confirmed ones, ordered alike)."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.schema["key"].dataType
    out = T.StructType([T.StructField("key", kind), *[T.StructField(c, T._parse_datatype_string(SPANS)) for c in ("base", "spans")]])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))

    def scan(batches):
        named = lambda spans: [{"start": a, "stop": z, "kind": KINDS[k]} for a, k, z in spans]
        for b in batches:
            base, every = [], []
            for t in b.column("text"):
                first, both = spans_of(t.as_py() or "")
                base.append(named(first))
                every.append(named(both))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(base, arrow), pa.array(every, arrow)], ["key", "base", "spans"])

    return d.mapInArrow(scan, out).select(F.col("key").alias(key), "base", "spans")


def span_list(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
