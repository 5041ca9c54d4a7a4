"""Names for token runs and pairs of tokens: a parse of word sequences that equal passages share.

Every word has a name made from its bytes. Names only lead to places that may be
equal; whether they are is told by a digest of the words themselves. A round names each run of equal
symbols, or gives every symbol a side made from its name and joins each left
symbol with a right symbol that follows it. A name is made from the names that
it stands for, so the same passage gets the same name in every document without
any exchange between tasks. Whether two neighbours are joined depends on them
alone; so inside a window all symbols are the same wherever its words stand, but
for a few at its ends, and which these are shows from the window itself.
"""

from hashlib import blake2b

import numpy as np

from .shared import WHITE

ROUNDS = 2
#: Longer words, in bytes, are named by XXH64.
LANES = 64
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S = tuple(np.uint64(x) for x in (27, 29, 31, 33, 40))

#: The first bytes of eight, by how many.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE)] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number scrambled, one to one."""
    x = (x ^ (x >> _S[3])) * _B
    x = (x ^ (x >> _S[1])) * _C
    return x ^ (x >> _S[2])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, length and first byte of each word of ``data``.

    Words of up to 8 bytes of one length have names of their own; longer ones take
    in 8 bytes after the other. Very long words are named by XXH64.
    """
    raw = np.frombuffer(data, np.uint8)
    solid = np.concatenate([[False], ~_WHITE[raw], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    eights = np.ndarray(len(raw) + 1, "<u8", data + bytes(8), strides=(1,))
    names = mixed(size.astype(np.uint64) * _A)
    for at in range(0, LANES, 8):
        open_ = np.flatnonzero(size > at)
        if not len(open_):
            break
        taken = eights[begin[open_] + at] & _KEEP[np.minimum(size[open_] - at, 8)]
        names[open_] = mixed(names[open_] ^ taken)
    long_ = np.flatnonzero(size > LANES).tolist()
    if long_:
        from xxhash import xxh64_intdigest

        names[long_] = [xxh64_intdigest(data[begin[i]:end[i]], 7) for i in long_]
    return names, size, begin


def digests(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each stretch of ``text``, as rows of two numbers."""
    found = b"".join([blake2b(text[a:b], digest_size=16).digest()
                      for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def window_hashes(names: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` consecutive names."""
    span, total = 1, names
    sums = {1: names}
    powers = {1: _A}
    while span * 2 <= window:
        power = powers[span]
        total = total[:-span] * power + total[span:]
        powers[span * 2] = np.uint64(int(power) ** 2 % (1 << 64))
        span *= 2
        sums[span] = total
    count = len(names) - window + 1
    result, at, rest = np.zeros(count, np.uint64), 0, window
    while rest:
        part = 1 << rest.bit_length() - 1
        result = result * powers[part] + sums[part][at:at + count]
        at, rest = at + part, rest - part
    return mixed(result)


def parse(names: np.ndarray, sizes: np.ndarray, owner: np.ndarray, window: int,
          rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of words: its name and the word where it begins.

    ``names`` and ``sizes`` are the words' names and lengths, ``owner`` a number
    for each word that changes where another document begins. The anchor is the
    longest symbol that the window alone determines, in the last round that
    leaves it any; it depends on the window's words only. Windows of one or two
    runs, of which no symbol is determined, are their own anchor. What windows
    that span documents get has no meaning.
    """
    count = len(names) - window + 1
    begins = np.concatenate([[True], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])])
    run = np.cumsum(begins) - 1
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(names)))
    symbol = np.where(length > 1, mixed(names[start] + length.astype(np.uint64) * _A), names[start])
    lo, hi = run[:count] + 1, run[window - 1:]
    before = np.concatenate([[0], np.cumsum(sizes)])

    anchor = window_hashes(names, window) ^ _C
    place = np.arange(count)
    open_ = np.flatnonzero(lo < hi)
    lo, hi = lo[open_], hi[open_]
    for number in range(rounds + 1):
        if number < rounds:
            left = (mixed(symbol ^ np.uint64(number + 1)) & np.uint64(1)).astype(bool)
            inner = lo + ~left[lo], hi - left[hi - 1]
            last = inner[0] >= inner[1]
        else:
            last = np.ones(len(open_), bool)
        if last.any():
            ends = np.append(start[1:], len(names))
            weight = (((before[ends] - before[start]).astype(np.uint64) << _S[4])
                      | (mixed(symbol ^ _A) >> np.uint64(24)))
            first, to = lo[last], hi[last]
            best = first.copy()
            for step in range(1, int((to - first).max(initial=1))):
                other = np.minimum(first + step, to - 1)
                best = np.where(weight[other] > weight[best], other, best)
            anchor[open_[last]] = mixed(symbol[best] ^ np.uint64(number + 101))
            place[open_[last]] = start[best]
        if number == rounds or last.all():
            break
        joins = left[:-1] & ~left[1:] & (owner[start[1:]] == owner[start[:-1]])
        opens = np.concatenate([[True], ~joins])
        index = np.cumsum(opens) - 1
        joined = symbol.copy()
        pairs = np.flatnonzero(joins)
        joined[pairs] = mixed(symbol[pairs] * _A + mixed(symbol[pairs + 1]))
        symbol, start = joined[opens], start[opens]
        open_ = open_[~last]
        lo, hi = index[inner[0][~last]], index[inner[1][~last] - 1] + 1
    return anchor, place
