"""Word shingles as 64-bit hashes and circulant MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_P = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_P), -1, 1 << 64))
#: Bytes hashed at once; longer texts go in pieces that end between words.
PIECE = 1 << 20
#: The folded universe of the circulant permutation.
UNIVERSE = 1 << 22

_powers: dict[str, np.ndarray] = {}
_circle: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 14), base, U)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 4 * PIECE:
            _powers[kind] = known
    return known[:n]


def _piece_words(data: bytes, ending_bits: int = 0) -> np.ndarray:
    return piece_words(data, ending_bits)[0]


def piece_words(data: bytes, ending_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words of data, already in lower case; at most a few PIECEs."""
    b = np.frombuffer(data, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = _BLANK[b]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U), starts
    total = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * _power("up", _P, len(b)), out=total[1:])
    h = mix((total[ends] - total[starts]) * _power("down", _INVERSE, len(b))[starts] + (ends - starts).astype(U))
    if not ending_bits:
        return h, starts
    before = np.where(ends - starts > 1, b[ends - 2], 0).astype(U)
    return (mix((before << U(8)) + b[ends - 1]) >> U(64 - ending_bits) << U(64 - ending_bits)) | (h >> U(ending_bits)), starts


def word_hashes(text: str | None, ending_bits: int = 0) -> np.ndarray:
    """A 64-bit hash of each word between ASCII blanks, A-Z in lower case, of the whole text. The first `ending_bits` bits of it
    are a hash of the word's last two bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= PIECE:
        return _piece_words(data, ending_bits)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        out.append(_piece_words(data[at:end], ending_bits))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingles of the text; a text of fewer words is one shingle, one without words has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = s * U(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(s + U(n)))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U), mix(s + U(0x5851F42D4C957F2D)).sum(dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def circle(coordinates: int) -> np.ndarray:
    """Row p: the second permutation's values at p, p+1, ... as the circulant shifts read them."""
    if coordinates not in _circle:
        order = np.random.default_rng(20240229).permutation(UNIVERSE).astype(np.uint32)
        _circle[coordinates] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)
    return _circle[coordinates]


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: the first permutation places each shingle, the second one, shifted by k, orders the places;
    coordinate k is the least value under shift k."""
    view = circle(coordinates)
    place = (mix(s + U(0x2545F4914F6CDD1D)) >> U(42)).astype(np.int64)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), 1024):
        np.minimum(least, view[place[at : at + 1024]].min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit hash for each band of `rows` coordinates; the band's number is hashed in."""
    bands = least.reshape(-1, rows).astype(U)
    h = np.arange(len(bands), dtype=U) * U(0x9E3779B97F4A7C15)
    for k in range(rows):
        h = mix(h * U(0xD6E8FEB86659FD93) + bands[:, k])
    return h.astype(np.int64)
