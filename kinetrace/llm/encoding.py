"""Text decoded with a wrong character encoding: find it, restore it.

A hidden Markov model labels the characters of a text that are not ASCII, piece by piece:
what stands between blanks, cut also where East Asian characters begin or end, so that a
span may begin inside a word.  It has one clean state and one state per pair (encoding of
the text, encoding it was read by).  The clean state emits characters by a bigram model
counted over the whole corpus; a pair's state emits the garbling of such text, so the
probability of a piece in it is that of the piece after the pair's inverse transform.
ASCII reads the same in every state and is passed over.  Two states stand for readings
that lost bytes: ``lost`` emits a replacement character where any other stood, ``stripped``
what is left of UTF-8 when control characters are dropped.  Labelled spans get the inverse
transform of their state; where bytes are lost, only what one reading alone can have been.
References to characters (``&#195;``) are read as the characters.

A piece whose original the sentence goes on to hold, and a replacement character alone
between quotation marks, is quoted, not garbled, and stays, whatever its state.

Null and empty texts, and texts without such characters, are never found; every text,
however long, is labelled whole.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings a text may have been read by, and may have been in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp852", "cp866", "iso8859-2")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp852", "cp866", "iso8859-2", "shift_jis", "euc_jp")
MULTI = ("shift_jis", "euc_jp")  #: those of WRITTEN_IN, beside utf-8, with characters of several bytes

ENTER, LEAVE = -7.0, -1.0  #: log weights of going from the clean state to another and back
ENTER_SINGLE = -14.0  #: the same for pairs of one-byte encodings, which any character fits
STAY = -0.01
BACKOFF = 0.05  #: weight of single characters beside pairs
UNSEEN = 1e-7
OWED = 0.5  #: a pair below this share of the characters it may be the bytes of is no evidence
LEAST_KANA = 4  #: characters a word of garbled kana has at least
LOST = "�"
NEAR = 80  #: characters within which a quotation and its restored form stand

TAIL = re.compile(r"[^\x00-\x7f][^\x00-\x20]*")  #: of a word, from its first character that is not ASCII
EAST = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uff00-\uffef]+|[^\u2e80-\u9fff\uac00-\ud7af\uff00-\uffef]+")
EASTERLY = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uff00-\uffef]")
REFERENCE = re.compile(r"&(?:#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});")
RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _table(codec: str) -> tuple[dict[str, int], list[str]]:
    """Character -> byte and byte -> character; undefined bytes pass as control characters."""
    back, there = {}, []
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        there.append(c)
        back.setdefault(c, b)
    for b in range(0x80, 0xA0):  # control characters a sloppy reader let through
        back.setdefault(chr(b), b)
    return back, there


def _lowered(back: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """Bytes a character may stand for in text put in lower case after it was garbled."""
    low: dict[str, set[int]] = {}
    for c, b in back.items():
        low.setdefault(c.lower(), set()).add(b)
    return {c: tuple(sorted(bs)) for c, bs in low.items()}


SINGLE = {c: _table(c) for c in {*READ_AS, *WRITTEN_IN} - {"utf-8", *MULTI}}
LOWERED = {c: _lowered(SINGLE[c][0]) for c in READ_AS if c != "latin-1"}
#: characters the model tells apart; all others stand for their class
KNOWN = {c for _, there in SINGLE.values() for c in there if ord(c) > 127} | {LOST} | set("←↑→↓⇐⇒✓✔✗✘★☆●○■□▲△▼▽♥♦♣♠")


def cls(c: str) -> str:
    """The character itself if known or ASCII, else one that stands for its script: bounds the model."""
    if c < "\x80":
        return c if not c.isdigit() else "0"
    if c in KNOWN:
        return c
    o = ord(c)
    if 0x3040 <= o < 0x30A0:
        return "あ"
    if 0x30A0 <= o < 0x3100:
        return "ア"
    if 0x2E80 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xFF00 <= o < 0xFFF0:
        return "一"
    if 0x300 <= o < 0x370:
        return "́"
    if o >= 0x1F000 or 0xFE00 <= o < 0xFE10 or o == 0x200D:
        return "\U0001f642"
    return "Ā" if o < 0x1000 else "က"


#: log of how many characters share a class: what one of them is less likely by
SHARE = {"あ": math.log(80), "ア": math.log(80), "一": math.log(2500), "\u0301": math.log(20), "\U0001f642": math.log(500), "Ā": math.log(500), "က": math.log(500)}


KANA = re.compile("[\u3000-\u30ff]")


@lru_cache(1 << 16)
def kana_bytes(word: str) -> bool:
    """Is the word, wrongly read, Japanese text in one of MULTI?  The clean state must not
    learn such words: kana have few leading bytes, so one text makes them look usual."""
    for read in READ_AS:
        back = SINGLE[read][0]
        if all(c in back for c in word):
            raw = bytes(back[c] for c in word)
            for written in MULTI:
                try:
                    seen = raw.decode(written)
                except UnicodeDecodeError:
                    continue
                n = sum(c > "\x7f" for c in seen)
                if n >= LEAST_KANA and 2 * len(KANA.findall(seen)) >= n:
                    return True
    return False


def words_of(text: str) -> list[tuple[int, str]]:
    """(position, word) of the words that hold more than ASCII."""
    out = []
    for m in TAIL.finditer(text):
        at = m.start()
        while at and text[at - 1] > " ":
            at -= 1
        out.append((at, text[at : m.end()]))
    return out


def remains(word: str) -> bool:
    """Does the word consist of what is left of East Asian UTF-8 bytes?"""
    pieces = EASTERN.findall(word)
    return len(pieces) >= 6 and sum(map(len, pieces)) >= 0.8 * sum(c > "\x7f" for c in word)


def without_bytes(text: str) -> str:
    """The text without words the clean state must not learn."""
    for word in {w for _, w in words_of(text) if len(w) >= 6}:
        if remains(word) or len(word) >= 2 * LEAST_KANA and kana_bytes(word):
            text = text.replace(word, " ")
    return text


def count_pairs(docs: DataFrame, text: str) -> DataFrame:
    """(a, b, n): neighbouring characters of which one is not ASCII, over all texts, ``without_bytes``."""

    def work(batches):
        from collections import Counter

        memo: dict[str, str] = {}
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for run in RUN.findall(without_bytes(x)):
                    total.update(zip(run, run[1:]))
            if len(total) > 200_000:
                yield from _pairs(total, memo)
                total = Counter()
        yield from _pairs(total, memo)

    counted = docs.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(text).mapInArrow(work, "a string, b string, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _pairs(total, memo):
    from collections import Counter

    out: Counter = Counter()
    for (a, b), n in total.items():
        for c in (a, b):
            if c not in memo:
                memo[c] = cls(c)
        out[memo[a], memo[b]] += n
    if out:
        a, b = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(list(out.values()), pa.int64())], ["a", "b", "n"])


class Model:
    """Clean bigrams, and the score of a word in every state against the clean one."""

    def __init__(self, pairs: list[tuple[str, str, int]]):
        self.total = max(1, sum(n for *_, n in pairs))
        self.first: dict[str, int] = {}
        self.single: dict[str, int] = {}
        self.pair: dict[tuple[str, str], int] = {}
        self.into: dict[str, int] = {}  # how often any character but ASCII follows, and is followed
        self.out_of: dict[str, int] = {}
        self.between = self.others = 0
        for a, b, n in pairs:
            if LOST in (a, b):
                continue  # no text has it of its own
            self.pair[a, b] = n
            self.first[a] = self.first.get(a, 0) + n
            self.single[b] = self.single.get(b, 0) + n
            if b > "\x7f":
                self.into[a] = self.into.get(a, 0) + n
            if a > "\x7f":
                self.out_of[b] = self.out_of.get(b, 0) + n
                self.others += n
                self.between += n * (b > "\x7f")
        self._disown()
        self.score = lru_cache(1 << 17)(self._score)
        self.log = lru_cache(1 << 17)(self._log)

    def _disown(self) -> None:
        """Drop pairs that are the UTF-8 bytes of a much commoner character, read wrongly:
        the corpus the clean state is counted over holds garbled texts too."""
        owed: dict[tuple[str, str], int] = {}
        for c in KNOWN & self.single.keys():
            raw = c.encode("utf-8")
            for read in READ_AS:
                seen = "".join(SINGLE[read][1][b] for b in raw)
                for pair in {*zip(seen, seen[1:])}:
                    owed[pair] = owed.get(pair, 0) + self.single[c]
        for pair, n in owed.items():
            if 0 < self.pair.get(pair, 0) < OWED * n:
                del self.pair[pair]

    def _log(self, a: str, b: str) -> float:
        a, b = cls(a), cls(b)
        if a < "\x80" and b < "\x80":
            return 0.0  # ASCII beside ASCII is the same in every state
        p = (1 - BACKOFF) * self.pair.get((a, b), 0) / (self.first.get(a, 0) + 1) + BACKOFF * self.single.get(b, 0) / self.total
        return math.log(p + UNSEEN) - SHARE.get(b, 0.0)

    def likelihood(self, word: str) -> float:
        return sum(map(self.log, " " + word, word + " "))

    def _lost(self, word: str) -> float:
        """Log probability of a word in which replacement characters stand for any others."""
        total = 0.0
        for a, b in zip(" " + word, word + " "):
            if LOST not in (a, b):
                total += self.log(a, b)
                continue
            if a == b:
                n, of = self.between, self.others
            elif b == LOST:
                n, of = self.into.get(cls(a), 0), self.first.get(cls(a), 0)
            else:
                n, of = self.out_of.get(cls(b), 0), self.others
            total += math.log((1 - BACKOFF) * n / (of + 1) + BACKOFF * n / self.total + UNSEEN)
        return total

    def _score(self, word: str) -> tuple[tuple[str, float, str, bool], ...]:
        """(state, gain, reading, is it the original) of each state that explains the word better than the clean one."""
        own = self.likelihood(word)
        if LOST in word:
            gain = self._lost(word) - own
            return (("lost", gain, word, False),) if gain > 0 else ()
        out = []
        readings = [(state, restored, True) for state, restored in inverses(word)]
        known = {r: self.likelihood(r) for r in {r for _, r, _ in readings}}
        for some, sure, more in unstrip(word, self.log):
            readings.append(("stripped", some, sure))
            known[some] = max(known.get(some, -math.inf), self.likelihood(some) + more)
        for state, restored, sure in readings:  # states that restore alike are kept: neighbours decide
            gain = known[restored] - own
            if gain > 0:
                out.append((state, gain, restored, sure))
        out.sort(key=lambda x: -x[1])
        return tuple(out)

    def label(self, words: list[str]) -> list[tuple[str, str, bool] | None]:
        """Viterbi over the words: (state, reading, is it the original) of garbled ones, None of clean ones."""
        scored = [self.score(w) for w in words]
        if not any(s and s[0][1] > -ENTER for s in scored) and sum(s[0][1] for s in scored if s) < -ENTER:
            return [None] * len(words)
        best: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
        for i, s in enumerate(scored):
            gains = {state: gain for state, gain, *_ in s}
            top = max(best.values(), key=lambda x: x[0])
            new = {}
            clean = best.get("", (-math.inf, ()))
            leave = max(((v + LEAVE, p) for k, (v, p) in best.items() if k), key=lambda x: x[0], default=(-math.inf, ()))
            new[""] = max(clean, leave, key=lambda x: x[0])
            for state, gain in gains.items():
                stay = best.get(state)
                enter = (max(clean[0], leave[0]) + (ENTER if state.startswith(("utf-8", "lost", "stripped")) else ENTER_SINGLE), (clean if clean[0] >= leave[0] else leave)[1])
                v, p = max(((stay[0] + STAY, stay[1]), enter) if stay else (enter,), key=lambda x: x[0])
                new[state] = (v + gain, ((i, state), p))
            for state, (v, p) in best.items():  # a state passes over a word it cannot explain at a loss
                if state and state not in new and v + 2 * LEAVE > top[0] + 4 * ENTER:
                    new[state] = (v + 2 * LEAVE, p)
            best = new
        _, path = max(((v + (LEAVE if k else 0), p) for k, (v, p) in best.items()), key=lambda x: x[0])
        found = {}
        while path:
            (i, state), path = path
            found[i] = state
        return [(found[i], *next(rest for st, _, *rest in s if st == found[i])) if i in found else None for i, s in enumerate(scored)]


def _decode_utf8(raw: bytes, word: str) -> str | None:
    out, at, changed = [], 0, False
    for m in UTF8.finditer(raw):
        try:
            c = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [word[at : m.start()], c]
        at, changed = m.end(), True
    return "".join(out) + word[at:] if changed else None


def _decode_lowered(word: str, low: dict[str, tuple[int, ...]]) -> str:
    out, at = [], 0
    while at < len(word):
        hit = None
        if word[at] > "\x7f":
            for lead in low.get(word[at], ()):
                n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
                rest = [[b for b in low.get(c, ()) if 0x80 <= b < 0xC0] for c in word[at + 1 : at + n]]
                if n and len(rest) == n - 1 and all(rest):
                    for tail in product(*rest):
                        try:
                            c = bytes((lead, *tail)).decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        if hit is None or (c == c.lower() and hit[0] != hit[0].lower()):
                            hit = c, n
        out.append(hit[0] if hit else word[at])
        at += hit[1] if hit else 1
    return "".join(out)


def _stripped() -> dict[str, list[str]]:
    """Remains of a character's UTF-8 bytes read as Latin-1 after control characters were
    dropped -> the characters it may have been."""
    out: dict[str, list[str]] = {}
    for c in sorted(KNOWN - {LOST}):
        if ord(c) >= 0xA0:
            seen = c.encode("utf-8").decode("latin-1")
            rest = re.sub("[\x80-\x9f]", "", seen)
            if rest != seen:
                out.setdefault(rest, []).append(c)
    return out


STRIPPED = _stripped()
EASTERN = re.compile("ã[\xa0-¿]?|[ä-é][\xa0-¿]?")


KEPT = math.log(4)  #: an East Asian character keeps one of four of the forms its bytes may leave


def unstrip(word: str, log) -> list[tuple[str, bool, float]]:
    """(reading, is it the original, log weight) of a word whose garbled characters lost some of their bytes.

    East Asian characters leave too little to tell one from the other: their reading has a
    sign for the script of each, and counts for all its characters.  Of others the likeliest
    is read, and is the original if it is the only one.
    """
    if len(EASTERN.findall(word)) >= 3 and "ã" in word:
        signs = EASTERN.sub(lambda m: "あ" if m.group()[0] == "ã" else "一", word)
        return [(signs, False, sum(SHARE[c] - KEPT for c in signs if c in "あ一"))]
    out, at, changed, sure = [" "], 0, False, True
    while at < len(word):
        took = word[at]
        if "\xc2" <= took <= "\xf4":
            keys = [k for k in (word[at : at + 3], word[at : at + 2], took) if k in STRIPPED]
            if keys:
                nxt = word[at + len(keys[0]) : at + len(keys[0]) + 1] or " "
                best = max(STRIPPED[keys[0]], key=lambda c: log(out[-1], c) + log(c, nxt if nxt < "\x80" else " "))
                sure &= len(STRIPPED[keys[0]]) == 1
                out.append(best)
                at += len(keys[0])
                changed = True
                continue
        out.append(took)
        at += 1
    return [("".join(out[1:]), sure, 0.0)] if changed else []


def deeper(once: str, read: str) -> list[tuple[str, str]]:
    """(state, restored word) of every further round of UTF-8 misreading, until no byte is left to decode.

    Each round shortens the word, so there are few.  Rounds of one reader are always states,
    mixed ones where they restore otherwise.
    """
    out, level = [], [((read,), once)]
    while level:
        below, seen = [], set()
        for chain, x in level:
            for again in dict.fromkeys(("cp1252", "latin-1", read)):
                back = SINGLE[again][0]
                y = _decode_utf8(bytes(back.get(c, 0) for c in x), x)
                if y and (y not in seen or {*chain[:-1]} <= {again}):
                    seen.add(y)
                    below.append(((again, *chain), y))
        out += [("utf-8>" + ">".join(chain), y) for chain, y in below]
        level = below
    return out


def inverses(word: str) -> list[tuple[str, str]]:
    """(state, restored word) for every pair that could have made the word."""
    out = []

    def add(state, restored):
        if restored and restored != word:
            out.append((state, restored))

    for read in READ_AS:
        back = SINGLE[read][0]
        raw = bytes(back.get(c, 0) for c in word)
        once = _decode_utf8(raw, word)
        if once:
            add(f"utf-8>{read}", once)
            for state, restored in deeper(once, read):
                add(state, restored)
        if read in LOWERED and word == word.lower():
            add(f"utf-8>{read}>lower", _decode_lowered(word, LOWERED[read]))
        if all(c in back for c in word):
            for written in WRITTEN_IN:
                if written in SINGLE and written != read:
                    there = SINGLE[written][1]
                    add(f"{written}>{read}", "".join(there[b] if b > 127 else c for b, c in zip(raw, word)))
                elif written in MULTI:
                    try:
                        add(f"{written}>{read}", raw.decode(written))
                    except UnicodeDecodeError:
                        pass
    return out


SENTENCE = re.compile(r"[.?!]\s|\n")
OPEN, CLOSE = "\"'`“”„‘‚«»‹›([{", "\"'`“”’‘«»‹›)]}"
MARKS = re.compile("^[\"'`“”„‘’‚«»‹›()\\[\\]{}.,;:!?]*(.*?)[\"'`“”„‘’‚«»‹›()\\[\\]{}.,;:!?]*$")


def _alone(text: str, at: int, word: str) -> bool:
    """Is the word nothing but replacement characters between quotation marks?"""
    core = MARKS.match(word).group(1)
    if not core or core.strip(LOST):
        return False
    a = at + word.index(core)
    return text[:a].rstrip()[-1:] in OPEN and text[:a].strip() != "" and text[a + len(core) :].lstrip()[:1] in CLOSE and text[a + len(core) :].strip() != ""


def quoted(text: str, at: int, word: str, restored: str) -> bool:
    """Does the sentence go on to hold, as it should be, what the word at ``at`` garbles?"""
    after = text[at + len(word) : at + len(word) + NEAR]
    stop = SENTENCE.search(after)
    after = after[: stop.start() + 1 if stop else NEAR]
    if LOST in restored:
        core = MARKS.match(word).group(1)
        whole = re.sub(f"{LOST}+", "[^\\\\x00-\\\\x7f]+", re.escape(core))
        return _alone(text, at, word) or bool(core.strip(LOST) and re.search(whole, after.replace(LOST, " ")))
    a = 0
    while a < min(len(word), len(restored)) and word[a] == restored[a]:
        a += 1
    b = 0
    while b < min(len(word), len(restored)) - a and word[-1 - b] == restored[-1 - b]:
        b += 1
    end = len(restored) - b
    while a > 0 and restored[a - 1].isalnum():
        a -= 1
    while end < len(restored) and restored[end].isalnum():
        end += 1
    return end > a and restored[a:end] in after


def read_references(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with references to characters read, and (position in it, position in the text) wherever the two shift."""
    if "&" not in text:
        return text, [(0, 0)]
    out, shifts, at, size = [], [(0, 0)], 0, 0
    for m in REFERENCE.finditer(text):
        c = html.unescape(m.group())
        if len(c) != 1 or c < "\x80":
            continue
        out += [text[at : m.start()], c]
        size += m.start() - at + 1
        at = m.end()
        shifts += [(size - 1, m.start()), (size, at)]
    return "".join(out) + text[at:], shifts


def pieces(text: str) -> list[tuple[int, str]]:
    """(position, piece): what is labelled at once."""
    out = []
    for at, word in words_of(text):
        parts = [(at, word)] if EASTERLY.search(word) is None else [(at + k.start(), k.group()) for k in EAST.finditer(word)]
        out += [p for p in parts if not p[1].isascii()]
    return out


def examine(model: Model, text: str) -> tuple[list[tuple[int, str, str, str | None]], str]:
    """Garbled pieces (position, piece, state, original if known) that are no quotations, and
    the text with the known originals in their place, all else as it is."""
    seen, shifts = read_references(text)
    found, words = pieces(seen), []
    labels = model.label([w for _, w in found])
    for (start, word), label in zip(found, labels):
        if label is not None and not quoted(seen, start, word, label[1]):
            words.append((start, word, label[0], label[1] if label[2] else None))

    def place(k: int) -> int:
        a, b = shifts[bisect_right(shifts, (k, len(text) + 1)) - 1]
        return b + k - a

    out, at = [], 0
    for start, word, _, original in words:
        if original is not None:
            out += [text[at : place(start)], original]
            at = place(start + len(word))
    return words, "".join(out) + text[at:]


def fit(docs: DataFrame, text: str = "text") -> list[tuple[str, str, int]]:
    """Pairs of the clean state, counted over all texts.  At most (characters known)^2 rows."""
    bound = (len(KNOWN) + 128 + 8) ** 2
    rows = count_pairs(docs, text).limit(bound + 1).toArrow()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} pairs of characters")
    return list(zip(*(rows.column(c).to_pylist() for c in ("a", "b", "n"))))


def garbled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_restored, states, restored): texts with garbled words, and the text restored.

    ``restored`` has the original of ``n_restored`` words, and the others as they are; it is
    null where no word could be restored.  Two passes over the texts, the
    first for the pairs of the clean state; nothing is shuffled but those counts.
    """
    pairs = docs.sparkSession.sparkContext.broadcast(fit(docs, text))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        model = Model(pairs.value)
        for batch in batches:
            rows = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, restored = examine(model, x)
                if words:
                    rows.append({key: k, "n_words": len(words), "n_restored": sum(w[3] is not None for w in words), "states": sorted({w[2] for w in words}), "restored": restored if restored != x else None})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(key, batch.schema.field(0).type), ("n_words", pa.int32()), ("n_restored", pa.int32()), ("states", pa.list_(pa.string())), ("restored", pa.string())]))

    return docs.where(F.col(text).rlike("[^\\x00-\\x7f]|&[#A-Za-z]")).select(key, text).mapInArrow(work, f"`{key}` {kind}, n_words int, n_restored int, states array<string>, restored string")
