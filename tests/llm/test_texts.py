"""Problems 6 to 8 against brute force, and on small awkward inputs."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import garble, leaks, packing, queries

DOCS = "doc_id bigint, text string"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def containers(segments):
    """Contents of each container and ranks used, from segments."""
    held = defaultdict(list)
    for size, first, n, each in segments:
        for b in range(first, first + n):
            held[b] += [size] * each
    return held


def best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 60))
def test_solve_is_valid_and_no_worse_than_best_fit(sizes, capacity):
    segments, n = packing.solve(dict(Counter(sizes)), capacity)
    held = containers(segments)
    assert sorted(s for c in held.values() for s in c) == sorted(sizes)
    assert all(sum(c) <= capacity for c in held.values()) and len(held) == n
    assert n >= -(-sum(sizes) // capacity)
    assert n <= best_fit(sizes, capacity) + 1


def optimum(sizes, capacity):
    best = best_fit(sizes, capacity)
    sizes = sorted(sizes, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominating_sets_keep_the_optimum(sizes):
    stock = packing._Stock(dict(Counter(sizes)))
    for j in list(stock.sizes):
        if group := packing._dominating(stock, j, 20):
            assert sum(group) <= 20 and not Counter(group) - Counter(sizes)
            rest = list((Counter(sizes) - Counter(group)).elements())
            assert 1 + (optimum(rest, 20) if rest else 0) == optimum(sizes, 20)


def test_pack_documents(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.choice([0, 3, 3, 3, 7, 11, 16, 17, 50, rnd.randint(1, 70)])) for i in range(2000)]
    packed = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), [("a", 16), ("b", 64)]).toPandas()
    for window, cap in (("a", 16), ("b", 64)):
        mine = packed[packed.window_id == window]
        assert mine.groupby("doc_id").tokens.sum().to_dict() == dict(sizes)
        assert mine.groupby("container").tokens.sum().max() <= cap
        assert mine.groupby("doc_id").piece.count().to_dict() == {i: max(1, -(-t // cap)) for i, t in sizes}
        cut = mine[mine.doc_id.isin([i for i, t in sizes if t > cap])]
        assert (cut[cut.container.str.startswith("d")].tokens == cap).all()


def test_packing_of_large_windows(spark):
    data = [(1, 524_288), (2, 1_000_000), (3, 3_500_000), (4, 1), (5, 475_712), (6, 1_000_001)]
    sizes = spark.createDataFrame(data, "doc_id bigint, tokens bigint")
    packed = packing.pack(sizes, [("m", 1_000_000), ("x", 4_000_000), ("y", 4_000_000)]).toPandas()
    for window, cap in (("m", 1_000_000), ("x", 4_000_000), ("y", 4_000_000)):
        mine = packed[packed.window_id == window]
        assert mine.groupby("doc_id").tokens.sum().to_dict() == dict(data)
        assert mine.groupby("container").tokens.sum().max() <= cap
    assert packed[packed.window_id == "m"].container.nunique() == 7
    with pytest.raises(ValueError):
        packing.pack(sizes, [("z", 1 << 23)])


def test_reduction_and_validity_reports(spark):
    sizes = spark.createDataFrame([(i, t) for i, t in enumerate([7, 3, 5, 5, 4, 6, 0, 23])], "doc_id bigint, tokens bigint")
    windows = spark.createDataFrame([("a", 10)], "window_id string, capacity_tokens int")
    assert rows(packing.reduction_report(sizes, windows)) == [("a", 7, 7)]
    packed = packing.pack(sizes, [("a", 10)])
    assert rows(packing.validity(packed, sizes, windows)) == [("a", 8, 0, 0, 0, 0, 0)]
    wrong = packed.where("doc_id <> 3").unionByName(packed.where("doc_id = 1"))
    assert rows(packing.validity(wrong, sizes, windows))[0][2:5:2] == (1, 1)


def test_packing_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.pack(empty, [("a", 5)]).count() == 0 and packing.pack(empty, []).count() == 0
    only_empty = packing.pack(spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, tokens bigint"), [("a", 5)])
    assert rows(only_empty, "doc_id", "piece", "tokens", "container") == [(1, 0, 0, "b0"), (2, 0, 0, "b0")]
    exact = packing.pack(spark.createDataFrame([(1, 10), (2, 5)], "doc_id bigint, tokens bigint"), [("a", 5)])
    assert rows(exact, "doc_id", "piece", "tokens") == [(1, 0, 5), (1, 1, 5), (2, 0, 5)]
    with pytest.raises(ValueError):
        packing.pack(empty, [("a", 0)])
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "word " * 50_000, 3), (4, "<|endoftext|>", 4)], DOCS + ", tokens int")
    got = dict(rows(packing.token_sizes(docs)))
    assert got[1] == got[2] == 0 and got[3] >= 50_000 and 1 <= got[4] <= 13


def test_p6_of_test_data(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    packed = queries.p6_pack(spark, sf).toPandas()
    caps = pd.read_parquet(f"{sf}/context_windows.parquet").set_index("window_id").capacity_tokens.to_dict()
    for window, cap in caps.items():
        mine = packed[packed.window_id == window]
        assert set(mine.doc_id) == set(docs.doc_id) and mine.groupby("container").tokens.sum().max() <= cap
    found = {r.doc_id for r in queries.p6_found(spark, sf).collect()}
    for d in docs.itertuples():  # bounds that hold for any of the tokenizers
        if d.doc_id in found:
            assert len(d.text.encode()) > max(caps.values())
        else:
            assert len(d.text.split()) <= max(caps.values())


def windows_of(text, words):
    w = leaks.words_of(text)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def test_leaks_of_test_data(spark, sf):
    docs, items = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/eval_items.parquet")
    where = defaultdict(set)
    for r in items.itertuples():
        for w in windows_of(r.text, 12):
            where[w].add(r.item_id)
    want = sorted({(d.doc_id, item) for d in docs.itertuples() for w in windows_of(d.text, 12) for item in where.get(w, ())})
    assert want and rows(queries.p7_found(spark, sf)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.lists(st.sampled_from("abcx"), max_size=40), st.integers(3, 5))
def test_search_equals_brute_force(items, doc, words):
    texts = [(i, " ".join(x)) for i, x in enumerate(items)]
    found = leaks.Patterns.of_texts(texts, words).search(" ".join(doc))
    have = [tuple(doc[i : i + words]) for i in range(len(doc) - words + 1)]
    want = {i: sum(h in windows_of(t, words) for h in have) for i, t in texts}
    assert {i: n for i, (n, _) in found.items()} == {i: n for i, n in want.items() if n}


def test_leaks_edge_cases(spark):
    run = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, f"zero {run}"), (2, "too short"), (3, None), (4, run.upper()), (4, run.upper())], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, f"x {run.replace(' ', '_')}!"), (2, run.rsplit(" ", 1)[0]), (3, None), (4, ""), (5, f"{run} " * 3), (6, "a " * 100_000 + run), (7, run.replace("six", "İx"))], DOCS
    )
    want = [(1, 1), (1, 4), (5, 1), (5, 4), (6, 1), (6, 4)]
    assert rows(leaks.leaks(docs, items), "doc_id", "item_id") == want
    assert rows(leaks.leaks(docs, items, block_patterns=20), "doc_id", "item_id") == want
    assert rows(leaks.leaks(docs, items)) == rows(leaks.leaks(docs, items, block_patterns=1))
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0
    assert dict((r.doc_id, r.n_runs) for r in leaks.leaks(docs, items).where("item_id = 4").collect()) == {1: 1, 5: 3, 6: 1}


CLEAN = [
    "NÃO CONFIRMADO – “AMANHÔ e «MANHû",
    "20 °C, √6, 18 £ © kashi — Âgé de 12 ans, où ça, déjà vu… L’été",
    "├── a\n│   └── b ─┐ ┌─┤",
    "Рёбра и “СССР” — ВСЁ проверено",
    "conta tistã.prã e hurcãlděn.prãěsk “irmã” amanhã…",
    "上位の組織単位は、アカウントを",
    "Die „größte“ Änderung; Řeřicha żółć",
    "soft­hyphen no break AMANHÃ É",
]


def test_clean_texts_stay():
    assert [t for t in CLEAN if garble.spans(t) or garble.is_marked(t)] == []


@pytest.mark.parametrize("encoding", garble.UTF8_READERS)
def test_utf8_round_trip(encoding):
    some = []
    for text in ("Das geprüfte Verzeichnis überschreibt Größe", "la sesión añade más", "жёлтый путь возвращает", "上位の組織単位", "nœud “où” – 20 °C ≥ 3", "L’été"):
        try:
            text.encode().decode(encoding)
        except UnicodeDecodeError:
            continue
        some.append(text)
    text = " | ".join(some)  # one text: short ones may be readings of several encodings
    mixed = f"Äußerst ok: {text.encode().decode(encoding)} und dann — fertig"
    fixed, n = garble.repair(mixed)
    assert n and fixed == f"Äußerst ok: {text} und dann — fertig"
    twice = mixed.encode().decode("latin-1")
    assert garble.spans(twice)
    if encoding in ("cp1252", "latin-1"):
        assert garble.repair(twice)[0] == f"Äußerst ok: {text} und dann — fertig"


def test_garbled_documents(spark):
    base = "der nächtliche Lauf löscht die ältesten Einträge und prüft die Größe"
    data = [(i, base) for i in range(8)] + [
        (20, base.encode("cp1252").decode("cp437")),
        (21, base.encode("cp1252").decode("utf-8", "replace")),
        (22, "ok " + base.encode("mac_roman").decode("latin-1")),
        (23, None),
        (24, ""),
        (25, "ASCII only " * 20_000),
        (26, "fÃ¼r " + "x" * 200_000),
        (27, "die ã¼bergeordnete"),
        (28, "ещё ñ€ð°ð· вечером"),
        (29, "§ 2: О” ≤ 14 ± 2 °C, la panne Г\u00a0 cause"),
        (50, garble._read("端末は次の確認まで結果を削除した".encode("cp932"), "cp1252")),
        (51, "端末は次の確認まで結果を削除した".encode("euc_jp").decode("cp1252")),
    ] + [(30 + i, t) for i, t in enumerate(CLEAN)]
    docs = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: r for r in garble.garbled_documents(docs).collect()}
    assert sorted(got) == [20, 21, 22, 26, 27, 28, 29, 50, 51]
    assert got[28].text == "ещё раз вечером" and got[29].text == "§ 2: Δ ≤ 14 ± 2 °C, la panne à cause" and got[50].text == got[51].text == "端末は次の確認まで結果を削除した"
    assert got[20].text == got[21].text == base and got[22].text == "ok " + base and got[27].text == "die übergeordnete"
    assert all(r.restored for r in got.values())
    assert rows(garble.garbled_documents(docs, block=1)) == rows(garble.garbled_documents(docs))
    assert garble.garbled_documents(docs.limit(0)).count() == 0


def test_reposts_of_a_garbled_text(spark):
    right = [(i, f"Die Prüfung {i} der Schlüssel") for i in range(4)]
    wrong = "Eine Prüfung ohne Schlüssel".encode("cp1252").decode("mac_roman")
    docs = spark.createDataFrame(right + [(10 + i, wrong) for i in range(30)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in garble.garbled_documents(docs).collect()}
    assert got == {10 + i: "Eine Prüfung ohne Schlüssel" for i in range(30)}


@pytest.mark.parametrize("text, reader", [("für", "iso8859-5"), ("año", "iso8859-5"), ("mañana não", "iso8859-5"), ("não", "koi8-r"), ("corazón", "koi8-r"), ("mąż", "mac_cyrillic"), ("für dich", "gbk"), ("für", "cp932"), ("año", "euc_jp")])
def test_letters_read_by_cyrillic_and_two_byte_readers(text, reader):
    garbled = text.encode().decode(reader)
    assert garbled != text and garble.repair(garbled)[0] == text


@pytest.mark.parametrize("reader", ["cp932", "gbk"])
def test_kana_read_by_two_byte_readers(reader):
    text = "これはテスト"
    assert garble.repair("a: " + text.encode().decode(reader, "ignore") + " b")[1]


@pytest.mark.parametrize("text", ["Её идёт ещё цёлый", "SQLдёшево, её API", "日本語のテキスト、管理者権限", "AD管理者とPC毎の目", "TV画面 user名 id毎", "ﾃｽﾄ ｶﾅ", "縺れた糸"])
def test_correct_text_of_such_letters(text):
    assert garble.spans(text) == []


LANGUAGES = {
    "hu": ("A gyűjtő őrzi az összes újabb csoportot, és törli a régi élőt", ["cp1252", "cp1250", "iso8859-2", "mac_roman", "cp852"]),
    "tr": ("Şeker ağacı, ışık ve gözlükçü İstanbul çarşısı", ["cp1252", "cp1254", "cp437", "mac_roman"]),
    "ro": ("Țară și știință, într-o bătaie de joc; România înaltă", ["cp1252", "cp1250", "iso8859-2", "mac_roman"]),
    "uk": ("Їжак і ґанок, Європа: її об’єднання є важливим", ["cp1252", "cp1251", "latin-1", "mac_roman", "cp437"]),
    "el": ("Η ομάδα διαγράφει τους παλιούς κόμβους και ελέγχει τα δικαιώματα", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"]),
    "vi": ("Nhóm này được kiểm tra mỗi tối và những quyền cũ bị xóa", ["cp1252", "latin-1", "mac_roman"]),
    "zh": ("这个组每天晚上都会被检查一次", ["cp1252", "latin-1", "mac_roman"]),
    "ko": ("이 그룹은 매일 밤 검사됩니다", ["cp1252", "latin-1", "mac_roman"]),
    "th": ("กลุ่มนี้ถูกตรวจสอบทุกคืน", ["cp1252", "latin-1", "mac_roman"]),
}


@pytest.mark.parametrize("text, reader", [(text, reader) for text, readers in LANGUAGES.values() for reader in readers])
def test_utf8_of_other_languages(text, reader):
    assert garble.spans(text) == [] and not garble.is_marked(text)
    garbled = garble._read(text.encode(), reader)
    assert garble.repair(garbled)[0] == text
    assert garble.repair(f"ok: {garbled} – end")[0] == f"ok: {text} – end"


@pytest.mark.parametrize("garbled, right", [("ÅŸeker", "şeker"), ("È›arÄƒ È™i", "țară și"), ("gyÅ±jtÅ‘", "gyűjtő"), ("Ñ—Ñ—", "її")])
def test_short_texts_of_other_languages(garbled, right):
    assert garble.repair(garbled)[0] == right


@pytest.mark.parametrize("text", ["«Il a parlé…»", "ŘÍŠE, ČÁST, RŮŽE, ÚŽASNÝ", "SPÓŁKA, OGÓŁ, RÓŻA", "—última vez—órale", "Ø 20 mm, 3×4", "mot–été", "ΜΈΓΑ, Ο Ίων Γ\xa03", "Це є її ґанок", "ÄÖÜ „Ä“"])
def test_correct_text_with_letters_near_signs(text):
    assert garble.spans(text) == []


def test_many_hits_and_deep_garbling():
    for n in (199, 200, 5000):
        assert garble.repair("fÃ¼r " * n + "pr³ft", {"pr³ft": "prüft", "fÃ¼r": "?"}) == ("für " * n + "prüft", n + 1)
    deep = "größer für"
    for _ in range(7):
        deep = garble._read(deep.encode(), "cp1252")
    assert garble.repair(deep)[0] == "größer für"
    assert garble.repair("Ã¼" * 100_000)[0] == "ü" * 100_000


def test_words_of_two_kinds_in_one_text(spark):
    base = ["der Lauf löscht und prüft", "er löscht und sie prüft", "wer prüft, löscht", "sie löscht, sie prüft"]
    mixed = f"der l{'ö'.encode('cp1252').decode('cp437')}scht und pr{'ü'.encode('cp1252').decode('mac_roman')}ft"
    docs = spark.createDataFrame([*enumerate(base), (10, mixed), (10, "xÃ¼x")], DOCS)
    for block in (1, 100):
        got = sorted((r.doc_id, r.text, r.restored) for r in garble.garbled_documents(docs, block=block).collect())
        assert got == [(10, "der löscht und prüft", True), (10, "xüx", True)]


def test_short_words_and_long_tokens(spark):
    long = "Ärztekammer" * 30
    right = [(i, f"vai até à rede {i} e à casa {long}") for i in range(120)]
    docs = spark.createDataFrame([*right, (200, "vai até " + "à".encode("cp1252").decode("cp1253") + " rede"), (201, long.encode("cp1252").decode("cp437")), (202, "το ΰ και α")], DOCS)
    got = {r.doc_id: r.text for r in garble.garbled_documents(docs).collect()}
    assert got == {200: "vai até à rede", 201: long}


def test_short_words_beside_longer_ones(spark):
    right = [(i, f"проверка {i} в журнале и запись в группе") for i in range(120)]
    wrong = "запись в журнале и в группе"
    docs = spark.createDataFrame([*right, (200, wrong.encode("cp1251").decode("cp1252")), (201, "â é è: dix â, rien ici")], DOCS)
    assert {r.doc_id: r.text for r in garble.garbled_documents(docs).collect()} == {200: wrong}


def test_many_short_words_after_the_last_longer_one():
    words = {"xyzö": "right", "å": "е"}
    assert garble.repair("xyzö å å " + "q " * 60 + "å å", words)[0] == "right е е " + "q " * 60 + "å å"


def test_one_garbled_letter_in_a_word():
    assert garble.repair("usunął zbƒôdne wpisy")[0] == "usunął zbędne wpisy"
    assert garble.spans("æóðíàëå") == []
