"""Tokens, packing and repair of texts."""

import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrace.llm import encoding, packing, tokens


@pytest.fixture(scope="module")
def coder():
    return tokens.encoder(tokens.VOCABULARY, tokens.PATTERN)


@pytest.fixture(scope="module")
def other():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("other", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "\t\r\n  ", "Don't stop", "naïve café 👩‍🔧", "<|endoftext|>", "日本語のテキスト", "a" * 30_000, "x1y2" * 3000, "\x00\x01", "é" * 700]


def test_ids_equal_another_implementation(coder, other):
    ids, offsets = coder.encode(TEXTS)
    for x, a, b in zip(TEXTS, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == (other.encode_ordinary(x) if x else [])
        assert other.decode(ids[a:b].tolist()) == (x or "")


@given(st.text(max_size=200))
@settings(deadline=None, max_examples=200)
def test_any_text(text):
    coder = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN)
    ids, _ = coder.encode([text])
    by_id = {v: k for k, v in coder.ranks.items()}
    assert b"".join(by_id[i] for i in ids.tolist()).decode() == text


def test_perfect_hash_knows_its_keys_and_no_others(coder):
    keys = list(coder.ranks)
    assert (coder.hash.find(keys) == np.array([coder.ranks[k] for k in keys])).all()
    assert (coder.hash.find([b"no such token at all", b"\xff\xfe\xfd", b""]) == -1).all()
    assert len(coder.hash.key) == len(keys) and len(set(coder.hash.key)) == len(keys)


def test_encoding_of_tables(spark):
    rows = [(k, x, "clash") for k, x in enumerate(TEXTS)] + [(None, "hi", ""), (0, "again", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode_texts(df).collect()
    assert len(got) == len(rows) and sorted(len(r.ids) for r in got)[:2] == [0, 0]
    back = tokens.decode_ids(tokens.encode_texts(df)).collect()
    assert [r.text for r in back] == [r[1] or "" for r in rows]
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_first_fit_equals_a_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(0, 101, rng.integers(1, 200)).tolist()
        bins, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, room in enumerate(bins) if room >= sizes[i]), len(bins))
            if k == len(bins):
                bins.append(100)
            bins[k] -= sizes[i]
            want[i] = k
        assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(len(sizes))]


def test_packing(spark):
    rows = [(k, "word " * n, "x") for k, n in enumerate([0, 5, 40, 64, 65, 700, 3, 3, 3])] + [(1, "word " * 5, ""), (None, None, ""), (None, "a b", ""), (99, " ", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp string")
    got = packing.pack_texts(df, capacity=64, group=4).collect()
    size = {}
    for r in got:
        size[r.container] = size.get(r.container, 0) + r.n_tokens
        assert r.container is not None
    assert max(size.values()) <= 64
    ids, offsets = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN).encode([r[1] for r in rows])
    assert sum(size.values()) == len(ids)
    assert {r.doc_id for r in got} == {r[0] for r in rows} and len([r for r in got if r.doc_id == 5]) == -(-int(np.diff(offsets)[5]) // 64)
    assert len([r for r in got if r.doc_id == 1]) == 2  # repeated rows are items of their own
    fill = packing.fill(packing.pack_texts(df, capacity=64, group=4), 64).collect()
    assert all(r.unused == 64 - r.n_tokens >= 0 for r in fill)
    assert packing.pack_texts(df.limit(0)).count() == 0


def test_little_space_is_left():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2048, (rng.lognormal(5, 1, 8192)).astype(int))
    bins = max(packing.first_fit_decreasing(sizes.tolist(), 2048)) + 1
    assert sizes.sum() / (bins * 2048) > 0.99


CLEAN = [
    "Könnte auch am Öl liegen, die Füße hängen schräg über der Tür.", "Après ça, l’été s’arrête déjà à Nîmes ; très gênant.", "Él leyó la guía del año pasado; ¿por qué no funcionó?",
    "Já limpei o coração da máquina, não é razão. ATENÇÃO: NÃO abra.", "Najpierw sprawdź łożysko, później ciasto, dzięki za odpowiedź.", "Спасибо за ответ! Сначала проверьте замок, потом меняйте ремень.",
    "すでに説明書を読みましたが、変わりません。ありがとうございます。", "It’s “quick” — really quick… café, naïve résumé: ½ inch at 5 °C, €5.",
]


TABLE = "╔══╦══╗\n║ a║ b║\n╚══╩══╝"


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    total = Counter()
    for x in [*CLEAN, TABLE]:
        for run in encoding.RUN.findall(x):
            total.update((encoding.cls(a), encoding.cls(b)) for a, b in zip(run, run[1:]))
    return encoding.Model([(a, b, 50 * n) for (a, b), n in total.items()])


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("k", range(len(CLEAN)))
def test_utf8_read_wrongly_is_restored(model, k, read):
    there = encoding.SINGLE[read][1]
    bad = "".join(there[b] for b in CLEAN[k].encode("utf-8"))
    if bad == CLEAN[k]:
        return
    words, restored = encoding.examine(model, "plain words\n" + bad)
    assert words and restored == "plain words\n" + CLEAN[k]


@pytest.mark.parametrize(("k", "written", "read"), [(0, "cp1252", "mac_roman"), (0, "cp1252", "cp1251"), (3, "mac_roman", "cp1252"), (2, "cp850", "cp1252"), (4, "cp1250", "cp1252"), (5, "cp1251", "cp1252"), (5, "koi8-r", "cp1251"), (5, "cp866", "cp1251"), (6, "shift_jis", "cp1252")])
def test_single_byte_pairs(model, k, written, read):
    there = encoding.SINGLE[read][1]
    bad = "".join(there[b] for b in CLEAN[k].encode(written))
    words, restored = encoding.examine(model, bad)
    assert words and restored == CLEAN[k]


def test_twice_lowered_lost_and_stripped(model):
    twice = CLEAN[0].encode("utf-8").decode("cp1252", "replace")
    once = "".join(encoding.SINGLE["cp1252"][1][b] for b in CLEAN[0].encode("utf-8"))
    twice = "".join(encoding.SINGLE["cp1252"][1][b] for b in once.encode("utf-8"))
    assert encoding.examine(model, twice)[1] == CLEAN[0]
    assert encoding.examine(model, once.lower())[0]
    assert encoding.examine(model, "so sch�n hier")[0]
    stripped = "".join(c for c in "It’s “quick”".encode("utf-8").decode("latin-1") if not "\x80" <= c <= "\x9f")
    assert encoding.examine(model, stripped + " and café" )[0]


def test_clean_and_quoting_texts_stay(model):
    quotes = ["The log prints cafÃ© where the form had café. Which side decodes it?", '`assert fix("GrÃ¶ÃŸe") == "Größe"` passes here.', "Why does my page show “Ã\xa0 la carte” instead of “à la carte”?"]
    for x in [*CLEAN, *quotes, "", "plain", " \n", TABLE, "👩‍🔧👍🏽"]:
        words, restored = encoding.examine(model, x)
        assert not words and restored == x


def test_nothing_is_made_up(model):
    eastern = "日本語の文字化けです。まずモーターを確認してください".encode("utf-8").decode("latin-1")
    stripped = "".join(c for c in eastern if not "\x80" <= c <= "\x9f")
    for bad in (stripped, "so sch�n hier", "caf� und T�r", "".join(c for c in "“quick”".encode("utf-8").decode("latin-1") if not "\x80" <= c <= "\x9f")):
        words, restored = encoding.examine(model, bad)
        assert words and restored == bad and all(w[3] is None for w in words)
    both = "sch�n, " + "Größe".encode("utf-8").decode("cp1252")
    words, restored = encoding.examine(model, both)
    assert len(words) == 2 and restored == "sch�n, Größe"


def test_replacement_characters_that_are_talked_about(model):
    for x in ('The character "�" is called the replacement character.', "I see ` � ` in the log.", "It prints caf� where the form had café.", "(�) means that a byte was lost"):
        assert encoding.examine(model, x) == ([], x)
    for x in ("� inch or � inch", 'He said "caf�" twice.', "Costs about �190"):
        assert encoding.examine(model, x)[0]


def test_references_to_characters(model):
    bad = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in CLEAN[3].encode("utf-8").decode("cp1252", "replace"))
    words, restored = encoding.examine(model, "5 &lt; 6 &#233; &amp; " + bad)
    assert words and restored == "5 &lt; 6 &#233; &amp; " + CLEAN[3]
    for x in ("caf&#233; na&iuml;ve &amp; &nbsp; &unknown;", "&#;&#99999999;&#xZZ; & &&"):
        assert encoding.examine(model, x) == ([], x)


def test_span_inside_a_word(model):
    bad = "".join(encoding.SINGLE["cp1251"][1][b] for b in "спасибо".encode("koi8-r"))
    garbled = "ありがとうございます" + "Größe, Füße".encode("utf-8").decode("cp1252") + "を確認"
    assert encoding.examine(model, garbled)[1] == "ありがとうございますGröße, Füßeを確認"
    assert encoding.pieces("変更" + bad + "確認")[1] == (2, bad)


def test_stretch_inside_a_long_text(model):
    bad = CLEAN[3].encode("utf-8").decode("latin-1")
    text = (CLEAN[3] + " plain. ") * 400 + bad + "\n" + CLEAN[3]
    words, restored = encoding.examine(model, text)
    assert words and restored == (CLEAN[3] + " plain. ") * 400 + CLEAN[3] + "\n" + CLEAN[3]


def test_garbled_tables(spark):
    bad = CLEAN[1].encode("utf-8").decode("cp1252", "replace")
    rows = [(k, x, "s") for k, x in enumerate(CLEAN * 20)] + [(1000, bad, "s"), (1000, bad, "s"), (1001, None, "s"), (1002, "", "s"), (1003, "lost �", None), (None, CLEAN[0].encode().decode("latin-1"), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, states string")
    got = encoding.garbled(df).collect()
    assert sorted(r.doc_id or -1 for r in got) == [-1, 1000, 1000, 1003]
    assert next(r for r in got if r.doc_id is None).restored == CLEAN[0] and next(r for r in got if r.doc_id == 1003).restored is None
    assert encoding.garbled(df.limit(0)).count() == 0


JAPANESE = "ありがとうございます。私の場合は、温度を下げたら直りました。\n\nすでに説明書を読みましたが、変わりません。まずモーターを確認してください。画面が5分後に止まります。なぜですか？"


def test_japanese_of_each_pair_though_the_clean_state_is_counted_over_it(spark):
    bad = {}
    for written in ("shift_jis", "euc_jp"):
        for read in encoding.READ_AS:
            there = encoding.SINGLE[read][1]
            bad[written, read] = "\n".join("".join(there[b] for b in line.encode(written)) for line in JAPANESE.split("\n"))
    texts = CLEAN * 20 + [3 * (x + "\n") for x in bad.values()]
    model = encoding.Model(encoding.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {pair for pair, x in bad.items() if encoding.examine(model, x)[1] != JAPANESE} == set()
    for x in CLEAN:
        assert encoding.examine(model, x) == ([], x)


@pytest.mark.parametrize("times", [3, 4, 5])
@pytest.mark.parametrize("k", [0, 2, 3, 5, 6])
def test_text_encoded_again_and_again(model, k, times):
    bad = mixed = CLEAN[k]
    for n in range(times):
        bad = "".join(encoding.SINGLE["cp1252"][1][b] for b in bad.encode("utf-8"))
        mixed = "".join(encoding.SINGLE[("latin-1", "cp1252")[n % 2]][1][b] for b in mixed.encode("utf-8"))
    assert encoding.examine(model, bad)[1] == CLEAN[k]
    assert encoding.examine(model, mixed)[1] == CLEAN[k]
