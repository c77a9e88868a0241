"""Many terms found in many texts by a scan of their bytes, whose cost hardly depends on how many terms there are.

Terms are cut into blocks of eight bytes, the last of one to eight, and blocks that follow the same ones share a node. At
every place of a text where a term may begin, eight bytes are one number, which is looked up among the blocks, and only places
where a whole block is met go on to the next. Numbers are compared whole, so what is found is the terms themselves, and all
of them, also those within others. Everything runs on arrays; a text is never cut into words.

UTF-8 is searched as it is: a term's bytes begin and end where characters do. Word boundaries are those of (?U)\\b.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Places looked at together, so that their numbers stay in a core's cache.
PLACES = 1 << 17
BLOCK = 8
#: Most places are left out by their first four bytes.
HEAD, HEAD_BITS = 4, 18
MASKS = [np.uint64((1 << 8 * n) - 1) for n in range(BLOCK + 1)]
CODES = 0x110000


class Table:
    """(node, number) -> a whole number from 0 on, for many pairs at once."""

    def __init__(self, found: dict[tuple[int, int], int]) -> None:
        nodes, values = (np.array(x, np.uint64) for x in zip(*found, strict=True))
        rng = np.random.default_rng(1)
        while True:  # other factors if two pairs mix to one number
            self.by_value, self.by_node = (x | np.uint64(1) for x in rng.integers(0, 1 << 64, 2, np.uint64))
            mixed = values * self.by_value + nodes * self.by_node
            order = np.argsort(mixed)
            if not (np.diff(mixed[order]) == 0).any():
                break
        self.values, self.mixed, self.out = values[order], mixed[order], np.array(list(found.values()), np.int64)[order]
        bits = min(max(12, (16 * len(mixed)).bit_length()), 24)
        self.shift = np.uint64(64 - bits)
        cells = (self.mixed >> self.shift).astype(np.int64)
        self.first = np.searchsorted(cells, np.arange(1 << bits)).astype(np.int32)
        self.used = np.bincount(cells, minlength=1 << bits)
        self.most, self.used = int(self.used.max()), self.used > 0

    def look(self, values: np.ndarray, nodes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are known, by place, and their numbers. nodes: None if all are 0."""
        mixed = values * self.by_value
        if nodes is not None:
            mixed += nodes.astype(np.uint64) * self.by_node
        cells = (mixed >> self.shift).view(np.int64)
        some = self.used.take(cells).nonzero()[0]
        mixed, values, at = mixed.take(some), values.take(some), self.first.take(cells.take(some))
        places, found = [], []
        for k in range(self.most):  # a cell's pairs stand together
            entry = np.minimum(at + k, len(self.mixed) - 1)
            hit = ((self.mixed.take(entry) == mixed) & (self.values.take(entry) == values)).nonzero()[0]
            places.append(some.take(hit))
            found.append(self.out.take(entry.take(hit)))
        # An entry that stands last may be met twice, which does no harm to what is a set.
        return np.concatenate(places), np.concatenate(found)


class Trie:
    """Distinct strings of bytes, none of them empty, by blocks; they are told by their places in the list."""

    def __init__(self, bodies: Sequence[bytes]) -> None:
        ends: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        goes: list[dict[tuple[int, int], int]] = []
        for i, body in enumerate(bodies):
            node, level = 0, 0
            while len(body) > BLOCK * (level + 1):
                if level == len(goes):
                    goes.append({})
                node = goes[level].setdefault((node, int.from_bytes(body[BLOCK * level : BLOCK * (level + 1)], "little")), len(goes[level]))
                level += 1
            rest = body[BLOCK * level :]
            ends.setdefault((level, len(rest)), {})[node, int.from_bytes(rest, "little")] = i
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        # Whether something of HEAD bytes or more may begin with these ones.
        heads = np.array(sorted({int.from_bytes(b[:HEAD], "little") for b in bodies if len(b) >= HEAD}), np.uint64)
        self.head = np.zeros(1 << HEAD_BITS, bool)
        self.head[self.mixed_head(heads)] = True
        self.goes = [Table(x) for x in goes]
        self.ends = [[(n, Table(x)) for (at, n), x in sorted(ends.items()) if at == level] for level in range(len(goes) + 1)] if bodies else []

    @staticmethod
    def mixed_head(values: np.ndarray) -> np.ndarray:
        return ((values << np.uint64(64 - 8 * HEAD)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HEAD_BITS)).view(np.int64)

    def find(self, numbers: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, strings that begin there); numbers: the eight bytes from each place on."""
        nodes = None
        for level, ends in enumerate(self.ends):
            values, short = numbers.take(places + BLOCK * level), level == 0
            for n, table in ends:
                if short and n >= HEAD:
                    may, short = self.head.take(self.mixed_head(values)).nonzero()[0], False
                    places, values = places.take(may), values.take(may)
                some, found = table.look(values & MASKS[n], nodes)
                yield places.take(some), found
            if level < len(self.goes):
                some, nodes = self.goes[level].look(values, nodes)
                places = places.take(some)
            if not len(places):
                break


def word_bytes(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 is of a word character; words: whether each code is one."""
    ascii_only = np.zeros(256, bool)
    ascii_only[:128] = words[:128]
    out = ascii_only[data]
    for begin in range(0, len(data), PLACES):  # what is found of characters takes far more than their bytes
        lead = begin + np.flatnonzero(data[begin : begin + PLACES] >= 0xC0)
        if not len(lead):
            continue
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in range(1, 4):
            code = np.where(size > k, code << 6 | data[np.minimum(lead + k, len(data) - 1)] & 0x3F, code)
        kind = words[np.minimum(code, CODES - 1)]
        for k in range(4):
            at = lead[size > k] + k
            out[at[at < len(data)]] = kind[size > k][at < len(data)]
    return out


class Scanner:
    """Terms (body, whether it begins at a word boundary, whether it ends at one) of which texts tell those that they hold."""

    def __init__(self, terms: Sequence[tuple[str, bool, bool]], words: np.ndarray) -> None:
        """words: whether each code is a word character."""
        self.count, self.words = len(terms), np.packbits(words)
        free = [(b.encode(), i) for i, (b, begins, ends) in enumerate(terms) if not (begins or ends)]
        self.free, self.free_term = Trie([b for b, _ in free]), np.array([i for _, i in free], np.int64)
        led: dict[bytes, list[int]] = {}  # a body -> its term that ends anywhere, that which ends at a boundary
        for i, (b, begins, ends) in enumerate(terms):
            if begins:
                led.setdefault(b.encode(), [-1, -1])[ends] = i
            elif ends:
                raise ValueError(f"a term that ends at a boundary but begins anywhere: {b}")
        self.led, self.led_terms = Trie(list(led)), np.array(list(led.values()), np.int64).reshape(-1, 2)

    def find(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row per text, whether it holds each term. data: the texts' bytes behind one another; ends: where each one ends."""
        out = np.zeros((len(ends), self.count), bool)
        flat, some = out.reshape(-1), np.diff(ends, prepend=0) > 0
        starts, stops, ids = (ends - np.diff(ends, prepend=0))[some], ends[some], np.flatnonzero(some)
        if not len(starts):
            return out
        word = word_bytes(data, np.unpackbits(self.words, count=CODES).astype(bool))
        begins = np.concatenate([[False], word[1:] != word[:-1], [False]])
        closes = begins.copy()
        begins[starts], closes[stops] = word[starts], word[stops - 1]
        ahead = BLOCK * max(len(self.free.ends), len(self.led.ends), 1)
        for at in range(0, len(data), PLACES):
            n = min(PLACES, len(data) - at)
            part = np.zeros(n + ahead + BLOCK, np.uint8)
            held = data[at : at + n + ahead + BLOCK]
            part[: len(held)] = held
            numbers = np.ascontiguousarray(np.ndarray(n + ahead, "<u8", part, strides=(1,)))
            for places, found in self.free.find(numbers, np.arange(n)):
                text = np.searchsorted(starts, places + at, "right") - 1
                whole = places + at + self.free.sizes[found] <= stops[text]
                flat[ids[text[whole]] * self.count + self.free_term[found[whole]]] = True
            for places, found in self.led.find(numbers, np.flatnonzero(begins[at : at + n])):
                text, end = np.searchsorted(starts, places + at, "right") - 1, places + at + self.led.sizes[found]
                whole = end <= stops[text]
                rows, terms, closed = ids[text[whole]] * self.count, self.led_terms[found[whole]], closes[end[whole]]
                for kind, on in ((0, terms[:, 0] >= 0), (1, (terms[:, 1] >= 0) & closed)):
                    flat[rows[on] + terms[on, kind]] = True
        return out
