"""Garbled text from wrong character encoding (problem 8).

Two kinds of garbling, both found by precomputed sequences:

* UTF-8 read as a one-byte encoding. Every character that the encodings of ``ENCODINGS`` can hold, and every sign, kana and
  combining mark, gives one garbled sequence for each reader; they stand in one multi-pattern automaton. Ideographs and
  other letters of three bytes share their first two garbled characters, so these prefixes are the patterns and the third
  character completes them. Sequences that may stand in correct text (an upper-case letter before a closing quote, a dash
  before a letter, box drawing, letters of one script) count only in a context where correct text has none. Garbling of
  garbled text is undone in rounds, until nothing is left to repair.
* One-byte text read as another one-byte encoding, or as UTF-8 with U+FFFD for what doesn't fit. There a garbled letter is
  just another letter, so the patterns are words: the corpus' own words garbled by all pairs of encodings. A garbled word is
  a pattern if the corpus holds it, but holds the correct word in ``RATIO`` times as many different texts, or in as many
  texts and ``RATIO`` times as many documents, so reposts of a garbled text don't hide it. Words of one or two letters need
  ``SHORT_RATIO`` and a longer garbled word near, or a garbled form of another script with none of that script near. Counts cover all documents; pairs are
  generated and joined distributed.

The garbled words of a document are looked up by hash, in one pass if the whole table of garbled words is at most ``block``
rows (broadcast), else by a join of the documents' words with that table. Both ways give a document the same words, and one
repair then uses all of them, so the result doesn't depend on the size.

Only matched spans are replaced. C1 control characters beside letters and U+FFFD mark a text as garbled even where
nothing restores them.

Defined results: null and empty texts are not garbled. ``restored`` is true if nothing garbled is left after repair and no
sequence had two equally likely originals. Repeated texts and repeated ids are each reported.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.runtime import cut

RATIO = 3
SHORT_RATIO = 50
BLOCK = 300_000
NEAR = 40  # characters between a short garbled word and a longer one that confirms it

# Public encodings, and letters that are frequent in the languages written with them.
UTF8_READERS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "mac_roman", "iso8859-2", "iso8859-15", "cp1254", "cp1257"]
LETTER_READERS = ["cp866", "koi8-r", "iso8859-5", "mac_cyrillic", "koi8-u", "cp1253", "iso8859-7", "cp1255", "cp1256"]
ENCODINGS = [
    *("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "iso8859-16", "mac_latin2", "cp852", "cp1254", "cp857", "mac_turkish", "cp1257", "iso8859-4", "iso8859-13", "cp775"),
    *("cp1251", "koi8-r", "koi8-u", "cp866", "iso8859-5", "mac_cyrillic", "cp855", "cp1253", "iso8859-7", "cp737", "mac_greek", "cp1255", "cp1256", "cp1258", "mac_roman", "cp437", "cp850"),
]
TWO_BYTE = ["cp932", "euc_jp"]
WIDE_READERS = ["cp932", "gbk", "euc_jp"]
COMMON = set("åÅäöüßÄÖÜáéíóúñàâæçèêëîïôœùûãõąćęłńśźżčďěňřšťůýžőűşğıİțșăĂ")
# Thai, Vietnamese, signs, kana, ideographs, Hangul, wide forms: what encodings hold beyond two bytes of UTF-8
WIDE = [(0xE01, 0xE5C), (0x1E00, 0x1F00), (0x2010, 0x2050), (0x20A0, 0x20C0), (0x2100, 0x2140), (0x2190, 0x2400), (0x2500, 0x27C0), (0x3000, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF01, 0xFFE6)]
SIGNS = "←↑→↓≈≠≤≥√∑∆∞№─│┌┐└┘├┤┬┴┼"

CYRILLIC = "".join(map(chr, range(0x410, 0x450))) + "Ёё"
_CLOSING = set("“”„‘’‚–—…«»‹›. ­")
_OPENING = set("“„‘‚–—«‹×÷·•†‡")
_BOXES = "─│┌┐└┘├┤┬┴┼"
_BOX = re.compile(r"[─-▟]+")
_TOKEN = re.compile(r"(?<![A-Za-z\x80-\U0010ffff])[A-Za-z]*+[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*+")
_REST = re.compile(r"[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*+")  # of a token, from its first character beyond ASCII
_PIECES = re.compile("[^’\\u00a0]+")
_RUN = re.compile("[^\x00-\x7f]{2,}")
_PLAIN = re.compile("[А-Яа-я\\u3000-\\u30ff\\u4e00-\\u9fff\\uac00-\\ud7a3\\uff00-\\uff60]+")
_WIDE = re.compile("[\\u3000-\\u30ff\\u4e00-\\u9fff\\uff00-\\uff9f]")
_ANY_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_C1 = re.compile(r"(?<=[^\W\d_])[\x80-\x84\x86-\x9f]|[\x80-\x84\x86-\x9f](?=[^\W\d_])")
_UNIT = re.compile("[°µ][A-Za-z]+")
_KANA = [chr(c) for c in (*range(0x3041, 0x3094), *range(0x30A1, 0x30F7), 0x30FC)]
_WIDE_RUN = re.compile("[　-ヿ一-鿿＀-ﾟ][^\x00-\x7f�]*")
_KANA_OR_CYRILLIC = re.compile("[Ѐ-џぁ-ー]")
_LEADS = {"cp932": re.compile("[縺繧繝][^\x00-\x7f]{0,3}[縺繧繝]"), "gbk": re.compile("[銇銈銉][^\x00-\x7f]{0,3}[銇銈銉]")}  # E3 81 to E3 83
_SCRIPTS = {"CYRILLIC": re.compile("[Ѐ-ӿ]"), "GREEK": re.compile("[Ͱ-Ͽ]"), "HEBREW": re.compile("[֐-׿]"), "ARABIC": re.compile("[؀-ۿ]")}


def _read(raw: bytes, encoding: str) -> str:
    """Decoded; bytes the encoding leaves open become the control characters of the same number."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)


@lru_cache(maxsize=64)
def _readings(encoding: str) -> list[str]:
    return [_read(bytes([b]), encoding) for b in range(256)]


@lru_cache(maxsize=64)
def _bytes_of(encoding: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_readings(encoding))}


def _unread(text: str, encoding: str) -> bytes | None:
    """The bytes a text was read from; None if it can't come from the encoding."""
    table = _bytes_of(encoding)
    raw = [table.get(c, -1) for c in text]
    return None if -1 in raw else bytes(raw)


@lru_cache(maxsize=1)
def held() -> frozenset[str]:
    """All printable characters beyond ASCII that the encodings can hold."""
    return frozenset(c for e in ENCODINGS for c in _readings(e)[128:] if c.isprintable() or c in " ­")


def _letter(ch: str) -> bool:
    return ch.isalpha() and ch.isprintable()


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    """Of a letter: LATIN, CYRILLIC, GREEK and so on; empty for other characters."""
    return unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() and ch not in "ªº" else ""


def _latin(ch: str) -> bool:
    return _script(ch) == "LATIN" if ch else False


def _context(garbled: str, lowered: bool, original: str = "") -> str | None:
    """What a sequence needs around it to count: '' nothing, or a kind of context (see ``spans``); None: it never counts."""
    if lowered:
        if garbled[1] in _CLOSING:
            return "inside" if garbled[1] != " " else None
        return "" if not garbled[1:].isalpha() or garbled[1] in "ªº" else None
    script = _script(garbled[0])
    if script in _SCRIPTS and all((c in CYRILLIC if script == "CYRILLIC" else _script(c) == script) or c in _CLOSING for c in garbled):
        return "run"
    if _BOX.fullmatch(garbled) or garbled[0] == "√" and garbled[1] in "°±∞≤≥":
        return "letter"
    if len(garbled) == 2 and garbled[0] in _OPENING and (garbled[1].isalpha() or garbled[1] in _CLOSING) or "\u0590" <= original < "\u0700":
        return "twin"
    if len(garbled) == 2 and garbled[0].islower() and garbled[0] != "ƒ" and all(map(_latin, garbled)):  # ƒ is used as a sign
        return "twin"
    if garbled[0].isalpha() and all(c in _CLOSING for c in garbled[1:]):
        return "quote" if len(garbled) == 2 and garbled[0].isupper() else "twin" if _script(original) not in ("", "LATIN") else ""
    return ""


@lru_cache(maxsize=1)
def sequences() -> ahocorasick.Automaton:
    """garbled sequence -> (length, original by reader or None, needed context, first two bytes by reader if it may go on)."""
    table: dict[str, tuple[dict[str, str], str | None]] = {}
    halfway = [*map(chr, range(0x80, 0x100)), *map(chr, (*range(0x300, 0x30D), 0x31B, *range(0x323, 0x329)))]  # between two garblings; combining marks
    narrow = dict.fromkeys([*halfway, *sorted(held()), *SIGNS])
    for encoding in UTF8_READERS + LETTER_READERS:
        readings = _readings(encoding)
        for ch in (*narrow, *_KANA):
            garbled = "".join(readings[b] for b in ch.encode())
            context = _context(garbled, False, ch)
            if encoding in LETTER_READERS and all(c.isalpha() for c in garbled):
                if not _latin(ch):  # stands among letters of its script, as correct text does
                    continue
                context = "mixed"
            table.setdefault(garbled, ({}, context))[0].setdefault(encoding, ch)
    for garbled, (by_reader, _) in list(table.items()):
        small = garbled.lower()
        letters = {e: ch.lower() for e, ch in by_reader.items() if _script(ch) in ("LATIN", "CYRILLIC")}
        if small == garbled or len(small) != len(garbled) or not letters:
            continue
        if garbled[0] in "ÐÑ":
            context = "run"
        elif garbled[0] not in "ÃÅÄĂĹ" or (context := _context(small, True)) is None:
            continue
        known, _ = table.setdefault(small, ({}, context))
        for encoding, ch in letters.items():
            known.setdefault(encoding, ch)
    for source in TWO_BYTE:
        for encoding in UTF8_READERS:
            for ch in _KANA:
                garbled = "".join(_readings(encoding)[b] for b in ch.encode(source))
                if not garbled.isascii() and not _latin(garbled[0]):
                    by_reader, context = table.setdefault(garbled, ({}, "kana"))
                    if context == "kana":
                        by_reader.setdefault(f"{source}>{encoding}", ch)
    prefixes: dict[str, dict[str, tuple[int, int]]] = {}
    for encoding in UTF8_READERS:
        readings = _readings(encoding)
        for a in range(0xE0, 0xF0):
            for b in range(0xA0 if a == 0xE0 else 0x80, 0xC0):
                prefixes.setdefault(readings[a] + readings[b], {})[encoding] = (a, b)
    out = ahocorasick.Automaton()
    for garbled in table.keys() | prefixes.keys():
        by_reader, context = table.get(garbled, (None, None))
        out.add_word(garbled, (len(garbled), by_reader, context, prefixes.get(garbled)))
    out.make_automaton()
    return out


def _completed(text: str, end: int, by_reader: dict) -> tuple[int, int, dict[str, str], str] | None:
    """The sequence of three that a prefix begins, if the third character makes it a letter of another script or a sign."""
    third, found = text[end : end + 1], {}
    for encoding, (a, b) in by_reader.items():
        c = _bytes_of(encoding).get(third, 0)
        code = (a & 15) << 12 | (b & 63) << 6 | c & 63
        if 0x80 <= c < 0xC0 and any(low <= code < high for low, high in WIDE):
            found[encoding] = chr(code)
    if not found:
        return None
    return end - 2, end + 1, found, _context(text[end - 2 : end + 1], False, next(iter(found.values())))


def hits_of(text: str) -> list[tuple[int, int, dict[str, str], str]]:
    """(start, end, original by reader, context) of the sequences in a text, in order and without overlap.

    Of overlapping sequences those of the reader that explains most of the text come first, then the earlier, then the longer.

    All characters of a sequence are beyond ASCII, so only runs of such characters are searched; runs of Russian letters or
    of kana and ideographs alone, not touched by a Latin letter, can't hold a sequence that counts."""
    found, search = [], sequences().iter
    for m in _RUN.finditer(text):
        run, at = m.group(), m.start()
        if _PLAIN.fullmatch(run) and not (text[at - 1 : at].isalpha() or text[m.end() : m.end() + 1].isalpha()):
            continue
        for end, (n, by_reader, context, goes_on) in search(run):
            if by_reader:
                found.append((at + end + 1 - n, at + end + 1, by_reader, context))
            if goes_on and (hit := _completed(text, at + end + 1, goes_on)):
                found.append(hit)
    if len(found) < 2:
        return found
    votes = Counter(e for h in found for e in h[2])
    top = max(votes.values())
    main = {e for e, n in votes.items() if n == top}
    covered, out = bytearray(len(text)), []
    for h in sorted(found, key=lambda h: (h[2].keys().isdisjoint(main), h[0], -h[1])):
        if not any(covered[h[0] : h[1]]):
            covered[h[0] : h[1]] = b"\x01" * (h[1] - h[0])
            out.append(h)
    return sorted(out, key=lambda h: h[0])


def _of_token(ch: str) -> bool:
    return ch > "\x7f" or ch.isascii() and ch.isalpha()


def _choice(by_reader: dict[str, str], votes: Counter) -> tuple[str, bool]:
    """The original by the reader that explains most of the text, then one that prints, then the more frequent letter, then
    the reader named first; and whether no other original is as likely by the text and the letter."""
    rank = {e: (votes[e], ch.isprintable(), ch in COMMON) for e, ch in by_reader.items()}
    best = max(rank.values())
    likely = [e for e in by_reader if rank[e] == best]
    return by_reader[likely[0]], len({by_reader[e] for e in likely}) == 1


def _mixed_spans(text: str, hits: list) -> list[tuple[int, int, str, bool]]:
    """Sequences of letters only, of readers of other scripts: they count inside a Latin word in lower case."""
    out = []
    votes = Counter(e for h in hits for e in h[2] if e in LETTER_READERS)
    starts, ends = {h[0] for h in hits}, {h[1] for h in hits}
    for start, end, by_reader, context in hits:
        if context == "mixed":
            before, after = text[max(0, start - 1) : start], text[end : end + 1]
            near = _SCRIPTS.get(_script(text[start]), _SCRIPTS["CYRILLIC"])
            touched = any(c.islower() and _latin(c) for c in (before, after) if c)
            if touched and (start in ends or not near.match(before)) and (end in starts or not near.match(after)):
                out.append((start, end, *_choice(by_reader, votes)))
    return out


def _whole(raw: bytes) -> str:
    """Bytes read as UTF-8, without a last character that is cut off; empty if they aren't UTF-8."""
    for cut_off in range(4):
        try:
            return raw[: len(raw) - cut_off].decode()
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data":
                return ""
    return ""


def wide_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """Spans of UTF-8 read as a two-byte encoding: three letters or more, or lower-case Latin letters inside a Latin word."""
    out = []
    for m in _WIDE_RUN.finditer(text):
        run, (start, end) = m.group(), m.span()
        for reader in WIDE_READERS:
            try:
                right = _whole(run.encode(reader))
            except UnicodeEncodeError:
                continue
            if not right or not all(c in held() or c in SIGNS or _WIDE.match(c) for c in right):
                continue
            touched = any(c and c.isascii() and c.islower() for c in (text[max(0, start - 1) : start], text[end : end + 1]))
            if len(right) >= 3 and any(_KANA_OR_CYRILLIC.match(c) for c in right) or touched and all(_latin(c) and c.islower() for c in right):
                out.append((start, end, right, True))
                break
        else:
            for reader, lead in _LEADS.items():  # characters lost: found, but not restored
                if lead.search(run):
                    out.append((start, end, run.encode(reader, "ignore").decode(errors="replace"), False))
                    break
    return out


def _sequence_spans(text: str, hits: list) -> list[tuple[int, int, str, bool]]:
    found = _mixed_spans(text, hits) if any(h[3] == "mixed" for h in hits) else []
    alone, agreed = [], Counter()  # sequences that want a twin count without one in a text garbled by their reader
    hits = [h for h in hits if h[3] != "mixed"]
    votes = Counter(e for h in hits for e in h[2])
    rest = text
    if any(h[3] == "run" for h in hits):  # what stands around the sequences
        parts, at = [], 0
        for start, end, _, _ in hits:
            parts += (text[at:start], " " * (end - start))
            at = end
        rest = "".join(parts) + text[at:]
    for k, (start, end, by_reader, context) in enumerate(hits):
        before, after = text[max(0, start - 1) : start], text[end : end + 1]
        near = [h for h in (hits[k - 1] if k and hits[k - 1][1] == start else None, hits[k + 1] if k + 1 < len(hits) and hits[k + 1][0] == end else None) if h is not None]
        if context == "run":
            script = _SCRIPTS[_script(text[start])] if _script(text[start]) in _SCRIPTS else _SCRIPTS["CYRILLIC"]
            ok = near or _latin(before) or _latin(after) or not script.search(rest[max(0, start - 15) : end + 15])
        elif context == "letter":
            ok = before.isalnum() or _letter(after) or near and near[0][1] == start
        elif context == "kana":  # two kana in a row in the same two-byte encoding
            ok = any(h[3] == "kana" and h[2].keys() & by_reader.keys() for h in near)
        elif context == "twin":
            ok = any(h[2].keys() & by_reader.keys() for h in near)
        elif context == "inside":
            ok = _letter(before) and _letter(after)
        elif context == "quote":
            ok = not (before.isupper() or before in "„“‚‘«»‹›”" and before) or near and near[0][1] == start or after.islower() and text[end - 1] not in "–— "
        else:
            ok = True
        if ok:
            found.append((start, end, *_choice(by_reader, votes)))
            agreed.update(by_reader.keys())
        elif context == "twin":
            alone.append((start, end, by_reader))
    return found + [(start, end, *_choice(by_reader, votes)) for start, end, by_reader in alone if any(agreed[e] >= 3 for e in by_reader)]


def _word_spans(text: str, words: dict[str, str]) -> list[tuple[int, int, str, bool]]:
    """The garbled words that stand in a text, whole or as a part between apostrophes and no-break spaces.

    A word of one or two letters counts beside a longer one, or if it is of another script of which there is nothing near."""
    out, short = [], []
    for m in _TOKEN.finditer(text):
        for start, end in [m.span(), *(p.span() for p in _PIECES.finditer(text, *m.span()))]:
            word = text[start:end]
            if word in words:
                (short if len(words[word]) < 3 else out).append((start, end, words[word], True))
                break
    starts, ends = [s[0] for s in out], [s[1] for s in out]
    for start, end, right, sure in short:
        k = bisect_left(starts, start)
        script = _SCRIPTS.get(_script(text[start]))
        beside = k < len(starts) and starts[k] - end <= NEAR or k > 0 and start - ends[k - 1] <= NEAR
        if beside or script is not None and _script(text[start]) != _script(right[-1]) and not script.search(text[max(0, start - 15) : start] + text[end : end + 15]):
            out.append((start, end, right, sure))
    return out


def spans(text: str, words: dict[str, str] | None = None, hits: list | None = None) -> list[tuple[int, int, str, bool]]:
    """(start, end, original, no other original as likely) of the garbled spans, in order and without overlap.

    Where spans overlap, sequences come before words, then the earlier, then the longer one."""
    hits = hits_of(text) if hits is None else hits
    found = [(s, 0) for s in _sequence_spans(text, hits) + wide_spans(text)]
    found += [(s, 1) for s in _word_spans(text, words)] if words else []
    found.sort(key=lambda s: (s[1], s[0][0], -s[0][1]))
    covered, out = bytearray(len(text)) if len(found) > 1 else None, []
    for s, _ in found:
        if covered is None or not any(covered[s[0] : s[1]]):
            out.append(s)
            if covered is not None:
                covered[s[0] : s[1]] = b"\x01" * (s[1] - s[0])
    return sorted(out)


def is_marked(text: str) -> bool:
    return "�" in text or _ANY_C1.search(text) is not None and _C1.search(text) is not None


def _two_byte_lines(text: str, hits: list) -> tuple[str, int]:
    """Lines read from a two-byte encoding, put right as a whole where all of the line fits; and their number."""
    votes = Counter(e for h in hits if h[3] == "kana" for e in h[2])
    if votes.total() < 2:
        return text, 0
    source, reader = votes.most_common(1)[0][0].split(">")
    lines, n = text.split("\n"), 0
    for i, line in enumerate(lines):
        if line.isascii() or not any(h[3] == "kana" for h in hits_of(line)):
            continue
        raw = _unread(line, reader)
        try:
            right = raw.decode(source) if raw is not None else line
        except UnicodeDecodeError:
            continue
        if right != line and len(re.findall("[ぁ-ー]", right)) >= 2 and not any(0xFF61 <= ord(c) < 0xFFA0 for c in right):
            lines[i], n = right, n + 1
    return "\n".join(lines), n


def repaired(text: str, words: dict[str, str] | None = None) -> tuple[str, int, bool]:
    """Text with its garbled spans replaced, their number in the first round, and whether all originals were certain.

    Rounds go on until nothing is found, or a text comes again."""
    first, certain, seen = 0, True, set()
    while hash(text) not in seen:
        turn = len(seen)
        seen.add(hash(text))
        hits = hits_of(text)
        text, whole = _two_byte_lines(text, hits)
        some = spans(text, words, None if whole else hits)
        if not turn:
            first = len(some) + whole
        if not some and not whole:
            return text, first, certain
        parts, at = [], 0
        for start, end, right, sure in some:
            parts += (text[at:start], right)
            at, certain = end, certain and sure
        text = "".join(parts) + text[at:]
    return text, first, False


def repair(text: str, words: dict[str, str] | None = None) -> tuple[str, int]:
    return repaired(text, words)[:2]


def tokens_of(text: str) -> set[str]:
    """Words with characters beyond ASCII, and their parts around apostrophes and no-break spaces."""
    out, found = set(), set()
    for m in _REST.finditer(text):
        start = m.start()
        while start and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        found.add(text[start : m.end()])
    for token in found:
        if not _WIDE.search(token):
            out.add(token)
            if "’" in token or " " in token:
                out.update(p for p in _PIECES.findall(token) if not p.isascii())
    return out


_NOT_ASCII = "length(text) < octet_length(text)"  # decided in the JVM, so texts of ASCII alone never go to Python


def word_counts(texts: DataFrame) -> DataFrame:
    """token, n: number of documents with the token, n_texts: number of different texts.

    Only (token, hash of its text) pairs are shuffled, never a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = Counter(batch.column(1).to_pylist())
            tokens, hashes, counts, done = [], [], [], set()
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h not in done:
                    done.add(h)
                    found = tokens_of(text)
                    tokens += found
                    hashes += [h] * len(found)
                    counts += [copies[h]] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64())], ["token", "h", "n"])

    pairs = texts.toDF("text").where(_NOT_ASCII).select("text", F.xxhash64("text")).mapInArrow(run, "token string, h bigint, n bigint")
    return pairs.groupBy("token", "h").agg(F.sum("n").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))


@lru_cache(maxsize=1)
def _tables() -> dict[str, dict[int, str]]:
    return {e: {128 + i: c for i, c in enumerate(_readings(e)[128:])} for e in ENCODINGS}


def garblings(word: str) -> set[str]:
    """All one-byte readings of a word, and the one as UTF-8 with U+FFFD."""
    raws, out = set(), set()
    for source in ENCODINGS:
        try:
            raws.add(word.encode(source))
        except UnicodeEncodeError:
            continue
    for raw in raws:
        plain = raw.decode("latin-1")
        out.update(plain.translate(t) for t in _tables().values())
        out.add(raw.decode("utf-8", "replace"))
    out -= {word}
    return {g for g in out if not g.isascii()}


def _may_be_right(word: str) -> bool:
    return (any(c.isalpha() or c in _BOXES for c in word) and all(c.isascii() or c in held() or c in _BOXES for c in word) or _UNIT.fullmatch(word) is not None) and not spans(word)


def garbled_words(counts: DataFrame, ratio: int = RATIO, short_ratio: int = SHORT_RATIO) -> DataFrame:
    """garbled, right: garbled forms of the corpus' words that the corpus holds, with the likeliest original."""
    # the characters of the corpus, at most as many as Unicode has: a form with any other can't be in it
    known = counts.select(F.explode(F.split("token", "")).alias("c")).distinct()
    letters = counts.sparkSession.sparkContext.broadcast(frozenset(r["c"] for r in known.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n, n_texts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not _may_be_right(word) or len(word) < 3 and not word.isalpha():
                    continue
                for g in garblings(word):
                    if letters.value.issuperset(g):
                        out.append((g, word, n, n_texts))
            if out:
                g, w, n, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], ["garbled", "right", "n", "n_texts"])

    forms = counts.where("n >= 2").select("token", "n", "n_texts").mapInArrow(run, "garbled string, right string, n bigint, n_texts bigint")
    held_by = counts.select(F.col("token").alias("garbled"), F.col("n").alias("held"), F.col("n_texts").alias("held_texts"))
    needed = F.when(F.length("right") < 3, short_ratio).otherwise(ratio)
    more = (F.col("n_texts") >= needed * F.col("held_texts")) | (F.col("n_texts") >= F.col("held_texts")) & (F.col("n") >= needed * F.col("held"))
    return forms.join(held_by, "garbled").where(more).groupBy("garbled").agg(F.max_by("right", F.struct("n", "right")).alias("right"))


def _looked_up(text: str) -> tuple[set[str], tuple[str, int, bool]]:
    """The words of a text that are looked up, as they stand and after the sequences are repaired; and that repair."""
    done = repaired(text)
    words = tokens_of(text)
    return words | tokens_of(done[0]) if done[1] else words, done


def _judged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Result rows of (doc_id, text, its repair)."""
    out = [(doc, n, certain and not is_marked(right), right) for doc, text, (right, n, certain) in rows if n or is_marked(text)]
    if out:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_spans", "restored", "text"])


_RESULT = "doc_id bigint, n_spans bigint, restored boolean, text string"


def _by_broadcast(texts: DataFrame, words: DataFrame) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast({r["garbled"]: r["right"] for r in words.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, done = _looked_up(text)
                if own := {t: table[t] for t in words & table.keys()}:
                    done = repaired(text, own)
                rows.append((doc, text, done))
            yield from _judged(rows)

    return texts.mapInArrow(run, _RESULT)


def _by_join(texts: DataFrame, words: DataFrame) -> DataFrame:
    """For a table of garbled words beyond one broadcast: the documents' words are joined with it, then with the texts."""
    texts = texts.withColumn("h", F.xxhash64("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tokens = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, _ = _looked_up(text)
                keys += [h] * len(found)
                tokens += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.string())], ["h", "garbled"])

    looked = texts.select("h", "text").mapInArrow(look, "h bigint, garbled string").distinct()
    own = looked.join(words, "garbled").groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("garbled", "right"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _judged([(doc, text, repaired(text, dict(own or ()))) for doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)])

    return texts.join(own, "h", "left").select("doc_id", "text", "own").mapInArrow(run, _RESULT)


def garbled_documents(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_spans, restored, text (repaired) of every garbled document. ``block``: most garbled words to broadcast."""
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where(_NOT_ASCII)
    words = cut(garbled_words(cut(word_counts(texts.select("text")))))
    return (_by_broadcast if words.count() <= block else _by_join)(texts, words)
