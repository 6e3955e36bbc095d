"""Ed25519 signatures after RFC 8032, in plain integers: no signing library is part of the environment.

Multiples of a point that comes often (the base point, keys that have checked some signatures) come from a table of 32 windows of eight bits, so
signing takes 32 additions and verifying 64. A key that has just been met takes some 380 steps instead, as its table costs as much as 40 of those.
This is not constant-time code: sign where nobody can time it, or keep keys in hardware and only verify here.
"""

from __future__ import annotations

import functools
import hashlib

#: Fixed values of the curve: field, group order, curve constant and the base point's coordinates.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
BASE_Y = 4 * pow(5, -1, P) % P

Point = tuple[int, int, int, int]  # X, Y, Z, T with x = X / Z, y = Y / Z, x * y = T / Z
ZERO: Point = (0, 1, 1, 0)


def add(a: Point, b: Point) -> Point:
    m, n = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = n - m, d - c, d + c, n + m
    return e * f % P, g * h % P, f * g % P, e * h % P


def _x_of(y: int, odd: int) -> int | None:
    """The x of a point with this y, None if there is none."""
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    if square == 0:
        return None if odd else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != odd else x


def pack(a: Point) -> bytes:
    inverse = pow(a[2], -1, P)
    x, y = a[0] * inverse % P, a[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def unpack(raw: bytes) -> Point | None:
    if len(raw) != 32:
        return None
    n = int.from_bytes(raw, "little")
    y = n & ((1 << 255) - 1)
    x = _x_of(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


#: Windows of eight bits: 32 rows of (y + x, y - x, 2 * D * x * y) of 0 to 255 times the row's point.
Table = list[list[tuple[int, int, int]]]
#: Signatures that a key checks in a worker before it gets a table of its own (2 MB), and tables held at once.
TABLE_AFTER, TABLES = 40, 64


def _inverses(xs: list[int]) -> list[int]:
    """Inverses of non-zero values, by one inversion."""
    before, product = [], 1
    for x in xs:
        before.append(product)
        product = product * x % P
    inverse, out = pow(product, -1, P), [0] * len(xs)
    for i in range(len(xs) - 1, -1, -1):
        out[i] = inverse * before[i] % P
        inverse = inverse * xs[i] % P
    return out


def _table(step: Point) -> Table:
    points = []
    for _ in range(32):
        points.append(ZERO)
        for _ in range(255):
            points.append(add(points[-1], step))
        step = add(points[-1], step)
    flat = []
    for (x, y, _, _), inverse in zip(points, _inverses([p[2] for p in points]), strict=True):
        x, y = x * inverse % P, y * inverse % P
        flat.append(((y + x) % P, (y - x) % P, 2 * D * x * y % P))
    return [flat[i : i + 256] for i in range(0, len(flat), 256)]


def _from_table(out: Point, table: Table, n: int) -> Point:
    """out and n times the table's point, n below 2**256."""
    x, y, z, t = out
    for row, byte in zip(table, n.to_bytes(32, "little"), strict=True):
        if byte:
            plus, minus, both = row[byte]
            a, b, c, d = (y - x) * minus % P, (y + x) * plus % P, t * both % P, 2 * z
            e, f, g, h = b - a, d - c, d + c, b + a
            x, y, z, t = e * f % P, g * h % P, f * g % P, e * h % P
    return x, y, z, t


@functools.lru_cache(maxsize=1)
def _base_table() -> Table:
    x = _x_of(BASE_Y, 0)
    return _table((x, BASE_Y, 1, x * BASE_Y % P))


def times_base(n: int) -> Point:
    return _from_table(ZERO, _base_table(), n)


def times(a: Point, n: int) -> Point:
    row = [ZERO]
    for _ in range(15):
        row.append(add(row[-1], a))
    out = ZERO
    for k in range(max(0, n.bit_length() - 1) // 4, -1, -1):
        for _ in range(4):
            out = add(out, out)
        out = add(out, row[n >> 4 * k & 15])
    return out


@functools.lru_cache(maxsize=1024)
def _secret(seed: bytes) -> tuple[int, bytes, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return a, h[32:], pack(times_base(a))


def public_key(seed: bytes) -> bytes:
    return _secret(seed)[2]


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix, public = _secret(seed)
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % ORDER
    first = pack(times_base(r))
    k = int.from_bytes(hashlib.sha512(first + public + message).digest(), "little") % ORDER
    return first + ((r + k * a) % ORDER).to_bytes(32, "little")


_known_key = functools.lru_cache(maxsize=1024)(unpack)


@functools.lru_cache(maxsize=TABLES)
def _uses(public: bytes) -> list:
    """[signatures checked, table of the negated key or None]."""
    return [0, None]


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """False for everything that is no valid signature, keys and signatures of wrong form included."""
    public = bytes(public)
    if len(signature) != 64:
        return False
    key, s = _known_key(public), int.from_bytes(signature[32:], "little")
    if key is None or s >= ORDER:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % ORDER
    uses, less = _uses(public), ((P - key[0]) % P, key[1], 1, (P - key[3]) % P)
    uses[0] += 1
    if uses[0] > TABLE_AFTER and uses[1] is None:
        uses[1] = _table(less)
    # the first half must be s * B - k * A in its only form; what is no point's form equals none
    left = times_base(s)
    return pack(_from_table(left, uses[1], k) if uses[1] else add(left, times(less, k))) == signature[:32]
