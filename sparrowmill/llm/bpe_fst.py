"""A byte-pair tokenizer compiled, on demand, to a deterministic transducer.

The transducer reads the UTF-8 bytes of normalised text. Reading byte ``b`` in
state ``q`` it moves to one state and emits one signed number: by how much the
token count of the text read so far changes. A state holds what the future can
still depend on: for each suffix of the current word that begins some token,
the last token of the canonical encoding before that suffix and the count of
tokens there, relative to the count now. States and transitions are made the
first time that they are met and kept in one dense table (a lazy subset
construction), which is cleared when it outgrows MAX_STATES.

Text is cut into chunks of equal length that all advance in lockstep, one numpy
gather a byte. What a chunk does is a map from entry state to exit state. Where a
word ends in a chunk, the transducer is back in its start state there: the map is
constant, and only the bytes up to that place (the head) depend on the entry. Inside
a longer word a chunk's map is made for the entries that can reach it, which are the
exits of the map before it and a guess; encodings soon fall into step, so these are
few. The maps are then composed by a prefix scan that doubles its windows, which gives
each chunk's own entry state, and all heads are run in lockstep from there.

The alphabet is every assigned character, but for controls and private use, that was
of the same kind (letter, number, white space, other) in Unicode 3.2, and so is in the
library's tables, of whichever version they are. Runs between white space that hold
another character or the string of a special token go to the tokenizers library
itself, as white space ends every word and the rest of the text isn't touched by that.
So does a piece of text that asks for more than NEW_STATES states, such as one of
random letters; it leaves no states behind.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

END = 256
SPACE = 512
CHUNK = 256
PIECE_BYTES = 3 << 19
MAX_STATES = 150_000
NEW_STATES = 50_000
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = re.compile(f"[{_WHITE}]")
#: code points beyond these have no letters of Unicode 3.2
_PLANES = 0x30000
_CLASS_SPACE, _CLASS_LETTER, _CLASS_NUMBER, _CLASS_OTHER = range(4)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _kind(c: str, version) -> int:
    if c in _WHITE:
        return _CLASS_SPACE
    return {"L": _CLASS_LETTER, "N": _CLASS_NUMBER}.get(version.category(c)[0], _CLASS_OTHER)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    return np.fromiter((_kind(chr(cp), unicodedata) for cp in range(_PLANES)), np.uint8, _PLANES)


@lru_cache(maxsize=1)
def alphabet() -> str:
    """The transducer's characters, as the inside of a character class."""
    old = unicodedata.ucd_3_2_0

    def belongs(c: str) -> bool:
        if c in _WHITE:
            return True
        if unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs"):
            return False
        return all(_kind(x, unicodedata) == _kind(x, old) for x in c + c.lower())

    ranges: list[list[int]] = []
    for cp in range(_PLANES):
        if belongs(chr(cp)):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _lower(text: str) -> str:
    """Lower case letter by letter: a sigma that ends a word is like any other."""
    return text.replace("Σ", "σ").lower()


def _entry(node: int, last: int, rel: int) -> int:
    """A suffix's node, the last token before it (-1: none) and the count there, in one number."""
    return node << 36 | last + 1 << 16 | rel + 32768


def _parts(entry: int) -> tuple[int, int, int]:
    return entry >> 36, (entry >> 16 & 0xFFFFF) - 1, (entry & 0xFFFF) - 32768


class _TooManyStates(Exception):
    pass


class BpeTransducer:
    """Counts and ids as ``Tokenizer.from_file(path)`` gives them, without added special tokens."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.mid = [vocab.get(letters[b], -1) for b in range(256)]
        self.last = [vocab.get(letters[b] + suffix, -1) for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        size = max(vocab.values()) + 1
        self.spelling: list[tuple[int, ...]] = [()] * size
        self.n_bytes = np.zeros(size, np.int32)
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for text, i in vocab.items():
            ended = text.endswith(suffix)
            body = text.removesuffix(suffix) if ended else text
            if not body or any(c not in byte_of for c in body):
                continue
            spelled = tuple(byte_of[c] for c in body) + (END,) * ended
            self.spelling[i] = spelled
            self.n_bytes[i] = len(body)
        for i, spelled in enumerate(self.spelling):
            if spelled and self._merged(spelled) == [i]:
                self._insert(spelled, i)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.escape = re.compile("|".join([f"[^{alphabet()}]", *special]))
        self.plain = re.compile(f"[{alphabet()}]*")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.classes = _class_table()
        self._valid = lru_cache(maxsize=1 << 16)(self._pair_stands)
        self._clear()

    @cached_property
    def library(self):
        """The tokenizers library's own tokenizer, loaded once a text needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    # -- compilation -------------------------------------------------------

    def _insert(self, spelled: tuple[int, ...], token: int) -> None:
        node = 0
        for s in spelled:
            nxt = self.children[node].get(s)
            if nxt is None:
                nxt = self.children[node][s] = len(self.children)
                self.children.append({})
                self.token_at.append(-1)
            node = nxt
        self.token_at[node] = token

    def _merged(self, spelled: tuple[int, ...]) -> list[int]:
        """Plain byte-pair encoding of one word, or of a word's beginning."""
        ended = spelled[-1] == END
        body = spelled[:-1] if ended else spelled
        ids = [self.mid[b] for b in body]
        if ended:
            ids[-1] = self.last[body[-1]]
        merge = self.merge
        while len(ids) > 1:
            best = min(((merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merge), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [merge[ids[k], ids[k + 1]][1]]
        return ids

    def _pair_stands(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is just these two."""
        return self._merged(self.spelling[a] + self.spelling[b]) == [a, b]

    def _clear(self) -> None:
        start = (_entry(0, -1, 0),)
        self.states = [start]
        self.number = {start: 0}
        self.symbols = np.full(SPACE + 1, -1, np.int32)
        self.symbol_list: list[int] = []
        #: next state, or at a word's end its last token, times 256, plus the count's change plus 128; 0: not made yet
        self.table = np.zeros((MAX_STATES + NEW_STATES, 128), np.int32)
        self.last_token = np.full(MAX_STATES + NEW_STATES, -1, np.int32)
        self.most = len(self.table)

    def _forget(self, mark: int) -> None:
        """Drop the states from number mark on, and the moves to them."""
        for key in self.states[mark:]:
            del self.number[key]
        del self.states[mark:]
        moves = [k for k, s in enumerate(self.symbol_list) if s < 256]
        kept = self.table[:mark, moves]
        kept[kept >> 8 >= mark] = 0
        self.table[:mark, moves] = kept
        self.table[mark:] = 0

    def _widen(self, cols: int) -> None:
        new = np.zeros((len(self.table), cols), np.int32)
        new[:, : self.table.shape[1]] = self.table
        self.table = new

    def _dense(self, raw: np.ndarray) -> np.ndarray:
        """Symbols renumbered in order of appearance, so the table stays narrow."""
        for s in np.flatnonzero(np.bincount(raw, minlength=SPACE + 1)):
            if self.symbols[s] < 0:
                self.symbols[s] = len(self.symbol_list)
                self.symbol_list.append(int(s))
        if len(self.symbol_list) > self.table.shape[1]:
            self._widen(len(self.symbol_list) + 16)
        return self.symbols[raw]

    def _make(self, q: int, dense: int) -> None:
        raw = self.symbol_list[dense]
        if raw == SPACE:
            self.table[q, dense] = 128
            return
        byte, ends = raw & 255, raw >= 256
        entries, delta, token = [_parts(e) for e in self.states[q]], None, -1
        for node, last, rel in entries:
            child = self.children[node].get(byte)
            if child is not None and ends:
                child = self.children[child].get(END)
            if child is None:
                continue
            t = self.token_at[child]
            if t >= 0 and (last < 0 or self._valid(last, t)):
                delta, token = rel + 1, t
                break
        if delta is None:
            raise ValueError(f"no token ends in byte {byte} after state {entries}")
        if ends:
            self.table[q, dense] = token << 8 | delta + 128
            return
        new = [_entry(0, token, 0)]
        for node, last, rel in entries:
            child = self.children[node].get(byte)
            if child is not None and self.children[child]:
                new.append(_entry(child, last, rel - delta))
        key = tuple(new)
        to = self.number.get(key)
        if to is None:
            to = len(self.states)
            if to >= self.most:
                raise _TooManyStates
            self.number[key] = to
            self.states.append(key)
            self.last_token[to] = token
        self.table[q, dense] = to << 8 | delta + 128

    def _look(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        width = self.table.shape[1]
        out = self.table.ravel().take(state * width + symbol)
        if not out.all():
            missing = out == 0
            for code in np.unique(state[missing].astype(np.int64) * width + symbol[missing]):
                self._make(int(code) // width, int(code) % width)
            out = self.table.ravel().take(state * self.table.shape[1] + symbol)
        return out

    # -- text to symbols ---------------------------------------------------

    def _symbols_of(self, data: np.ndarray) -> np.ndarray:
        """Bytes, 256 more where a byte ends its word, SPACE for white space."""
        n = len(data)
        lead = (data & 0xC0) != 0x80
        cp = data.astype(np.int32)
        for least, mask, more in ((0xC0, 31, 1), (0xE0, 15, 2), (0xF0, 7, 3)):
            at = np.flatnonzero(data >= least)
            point = cp[at] * 0 + (data[at] & mask)
            for k in range(1, more + 1):
                point = point << 6 | data[at + k] & 63
            cp[at] = point
        chars = np.flatnonzero(lead)
        kind = self.classes[cp[chars]]
        point = cp[chars]
        m = len(chars)
        start = np.ones(m, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _CLASS_NUMBER)
        quote = np.flatnonzero((point == 39) & start)
        if len(quote):
            padded = np.append(point, [32, 32, 32])
            one, next_ = padded[quote + 1], padded[quote + 2]
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
            for a, b in ("re", "ve", "ll"):
                size[(one == ord(a)) & (next_ == ord(b))] = 2
            hit = quote[size > 0]
            size = size[size > 0]
            start[hit + 1] = False
            after = hit + 1 + size
            start[after[after < m]] = True
        ends_char = np.ones(m, bool)
        ends_char[:-1] = start[1:]
        last_byte = np.append(chars[1:], n) - 1
        out = data.astype(np.int32)
        out[last_byte[ends_char]] += 256
        white = kind == _CLASS_SPACE
        for k in range(3):
            out[np.minimum(chars[white] + k, last_byte[white])] = SPACE
        return out

    # -- running -----------------------------------------------------------

    def _run(self, data: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Count change at each byte, ids at the byte where their token ends (else -1)."""
        if len(self.states) > MAX_STATES:
            self._clear()
        self.most = len(self.states) + NEW_STATES
        n = len(data)
        raw = self._symbols_of(data)
        resets = raw >= 256
        lanes = -(-n // CHUNK)
        full = np.full(lanes * CHUNK, SPACE, np.int32)
        full[:n] = raw
        sym = self._dense(full)
        ends_word = np.asarray([s >= 256 for s in self.symbol_list])
        blank = int(self.symbols[SPACE])
        reset = np.ones(lanes * CHUNK, bool)
        reset[:n] = resets
        reset = reset.reshape(lanes, CHUNK)
        solid = ~reset.any(1)
        head = np.where(solid, CHUNK, reset.argmax(1) + 1)
        head[0], solid[0] = 0, False  # the first chunk starts in the start state
        own = sym.reshape(lanes, CHUNK)
        column = np.arange(CHUNK)
        masked = np.where(column < head[:, None], blank, own).T.copy()
        deltas = np.zeros((CHUNK, lanes), np.int16)
        before = np.zeros((CHUNK, lanes), np.int32) if want_ids else None
        state = np.zeros(lanes, np.int32)
        for t in range(CHUNK):
            if want_ids:
                before[t] = state
            v = self._look(state, masked[t])
            deltas[t] = (v & 255) - 128
            state = np.where(ends_word[masked[t]], 0, v >> 8)
        lane = np.flatnonzero(head > 0)
        entry = self._exits(state, solid, own, ends_word)[lane - 1]
        for t in range(int(head.max(initial=0))):
            live = head[lane] > t
            lane, entry = lane[live], entry[live]
            if want_ids:
                before[t, lane] = entry
            v = self._look(entry, own[lane, t])
            deltas[t, lane] = (v & 255) - 128
            entry = np.where(ends_word[own[lane, t]], 0, v >> 8)
        flat = deltas.T.reshape(-1)[:n]
        if not want_ids:
            return flat, None, raw
        states = before.T.reshape(-1)[:n]
        at = np.full(n, -1, np.int32)
        ends = np.flatnonzero(resets & (raw < SPACE))
        token = self.table.ravel().take(states[ends].astype(np.int64) * self.table.shape[1] + sym[ends]) >> 8
        begins = np.zeros(n + 1, bool)
        begins[0] = True
        begins[1:] = resets
        while len(ends):
            at[ends] = token
            ends = ends - self.n_bytes[token]
            live = ends >= 0
            live[live] = ~begins[ends[live] + 1]
            ends = ends[live]
            token = self.last_token[states[ends + 1]]
        return flat, at, raw

    def _exits(self, exits: np.ndarray, solid: np.ndarray, own: np.ndarray, ends_word: np.ndarray) -> np.ndarray:
        """Exit states of all chunks: the prefix scan of the chunks' maps.

        exits holds those of constant maps; solid marks the other chunks.
        """
        lanes = np.flatnonzero(solid)
        if not len(lanes):
            return exits
        first = ~solid[lanes - 1]
        states = np.int64(len(self.table))
        asked = lanes * states + np.where(first, exits[lanes - 1], 0)  # the guess: a word begins here
        pairs, results = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(asked):  # until each map knows all exits of the one before
            lane, state = asked // states, asked % states
            for t in range(CHUNK):
                symbol = own[lane, t]
                state = np.where(ends_word[symbol], 0, self._look(state, symbol) >> 8)
            pairs, results = np.concatenate([pairs, asked]), np.concatenate([results, state])
            order = np.argsort(pairs)
            pairs, results = pairs[order], results[order]
            on = np.append(solid, False)[lane + 1]
            asked = np.setdiff1d((lane[on] + 1) * states + state[on], pairs)

        # maps by number: of an entry in the own chunk's list to one in the next chunk's
        begin = np.searchsorted(pairs, lanes * states)
        row = np.searchsorted(lanes, pairs // states)
        goes_on = np.append(~first[1:], False)
        maps = np.zeros((len(lanes), int(np.bincount(row).max())), np.int32)
        on = goes_on[row]
        after = np.searchsorted(pairs, (pairs[on] // states + 1) * states + results[on])
        maps[row[on], (np.arange(len(pairs)) - begin[row])[on]] = after - begin[row[on] + 1]
        low = np.arange(len(lanes))
        run = np.maximum.accumulate(np.where(first, low, 0))
        while (short := np.flatnonzero(low > run)).size:
            left = low[short] - 1
            maps[short], low[short] = np.take_along_axis(maps[short], maps[left], 1), low[left]
        entry = np.where(first, 0, np.roll(maps[:, 0], 1))
        out = exits.copy()
        out[lanes] = results[begin + entry]
        return out

    def _items(self, texts: list[str | None]) -> tuple[list[bytes], list[int], list[tuple[int, int, str]]]:
        """Byte strings to run with their text's number, and runs for the library with their place."""
        items, owner, escapes = [], [], []

        def run(text: str, k: int) -> None:
            at = 0
            while at < len(text):
                gap = _GAP.search(text, at + PIECE_BYTES // 2)
                end = gap.end() if gap else len(text)
                items.append(_lower(text[at:end]).encode())
                owner.append(k)
                at = end

        for k, text in enumerate(texts):
            if not text:
                continue
            if not text.isascii():
                text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
            if self.plain.fullmatch(text) and not any(s in text for s in self.special):
                run(text, k)
                continue
            at = 0
            for m in self.escape.finditer(text):
                if m.start() < at:
                    continue
                begin = m.start()
                while begin > at and text[begin - 1] not in _WHITE:
                    begin -= 1
                run(text[at:begin], k)
                gap = _GAP.search(text, m.end())
                at = gap.start() if gap else len(text)
                escapes.append((len(items), k, text[begin:at]))
            run(text[at:], k)
        return items, owner, escapes

    def _library_ids(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _pieces(self, items: list[bytes]):
        """Items in groups of bounded size, joined by a space."""
        lo = 0
        while lo < len(items):
            hi, total = lo, 0
            while hi < len(items) and (hi == lo or total + len(items[hi]) < PIECE_BYTES):
                total += len(items[hi]) + 1
                hi += 1
            sizes = np.fromiter((len(x) + 1 for x in items[lo:hi]), np.int64, hi - lo)
            yield lo, hi, np.frombuffer(b" ".join(items[lo:hi]) + b" ", np.uint8), np.cumsum(sizes)
            lo = hi

    def counts(self, texts: list[str | None]) -> np.ndarray:
        items, owner, escapes = self._items(texts)
        out = np.zeros(len(texts), np.int64)
        for lo, hi, data, ends in self._pieces(items):
            try:
                deltas, _, _ = self._run(data, False)
            except _TooManyStates:
                self._forget(self.most - NEW_STATES)
                own = [len(self._library_ids(x.decode())) for x in items[lo:hi]]
            else:
                totals = np.concatenate([[0], np.cumsum(deltas, dtype=np.int64)])
                own = np.diff(totals[np.concatenate([[0], ends])])
            np.add.at(out, np.asarray(owner[lo:hi]), own)
        for _, k, run in escapes:
            out[k] += len(self._library_ids(run))
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        items, owner, escapes = self._items(texts)
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting = iter([*escapes, (len(items) + 1, -1, "")])
        place, k, run = next(waiting)
        for lo, hi, data, ends in self._pieces(items):
            try:
                _, at, _ = self._run(data, True)
            except _TooManyStates:
                self._forget(self.most - NEW_STATES)
                at = None
            begin = 0
            for j in range(lo, hi):
                while place <= j:
                    parts[k].append(self._library_ids(run))
                    place, k, run = next(waiting)
                own = at[begin : ends[j - lo]] if at is not None else self._library_ids(items[j].decode())
                parts[owner[j]].append(own[own >= 0])
                begin = ends[j - lo]
        while k >= 0:
            parts[k].append(self._library_ids(run))
            place, k, run = next(waiting)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]


@lru_cache(maxsize=2)
def transducer(path: str) -> BpeTransducer:
    """One compiled transducer for each worker process and vocabulary."""
    return BpeTransducer(path)
