"""The corpus operators against brute force, libraries, and awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from seqspark.llm import audio, byte_bpe, chat_format, common, embed_dups, html_text, jaccard, mixing, quality, queries, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, i string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rnd, n):
    return " ".join(rnd.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, nulls in every column, empty, blank and long texts, repeated rows."""
    rnd = random.Random(3)
    base = prose(rnd, 120)
    texts = [base, base, base + " omega", base.replace("beta", "Beta"), None, "", " \n\t", "one", "One", "two words", "a b c", "A B C", "é ñ 中文 😀 <|endoftext|> don't WE'LL", prose(rnd, 3000), "x" * 3000]
    for _ in range(40):
        w = prose(rnd, rnd.choice([4, 11, 15, 18, 25, 60])).split()
        texts += [" ".join(w), " ".join([*w, "extra"]), " ".join(w[:-1])]
    out = [(k, t, ["en", "de", None][k % 3], ["s1", "s2", None, "s0"][k % 4], len(t or ""), 0.5, 1, "x") for k, t in enumerate(texts)]
    return [*out, (None, base, "en", "s1", None, None, None, None), (None, None, None, None, None, None, None, None), out[0], out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def collect(df):
    return [r.asDict() for r in df.collect()]


def texts_of(rows):
    return {r[0]: r[1] or "" for r in rows if r[0] is not None}


def test_byte_bpe(docs, none, rows):
    path = P.path("byte_bpe_50k.tiktoken")
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = collect(byte_bpe.digests(docs, path, with_ids=True))
    assert len(out) == len(rows)
    own = texts_of(rows)
    for r in out:
        if r["doc_id"] is not None:
            ids = lib.encode_ordinary(own[r["doc_id"]])
            raw = np.array(ids, "<u4").tobytes()
            assert (r["n_tokens"], r["ids"]) == (len(ids), raw)
            assert r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(own[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.digests(none, path).count() == 0


def test_byte_bpe_random_pieces():
    import tiktoken

    bpe = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.tokens)}, special_tokens={})
    rnd = random.Random(1)
    parts = ["'s", "'re", "'", "ll", " ", "  ", "\n", "a", "bc", "é", "中文", "😀", "1", "½", "!", "##", "Ab", "\x1c", "\x85", "İ"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(500)] + ["ab" * 600, "!" * 700]
    for text, ids in zip(texts, bpe.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_token_counts(docs, none, rows):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), texts_of(rows)
    out = collect(token_counts.token_counts(docs, path, limit=100))
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            n = len(lib.encode(own[r["doc_id"]], add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(own[r["doc_id"]].encode()), n > 100)
    assert token_counts.token_counts(none, path).count() == 0


def test_token_counts_chunks(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "STATES", 300)
    path = P.path("word_bpe_49k.json")
    counter, lib, rnd = token_counts.Counter(path), Tokenizer.from_file(path), random.Random(2)
    texts = ["".join(rnd.choices("etaoinshrdlu  '", k=rnd.randint(0, 200))) for _ in range(200)] + ["thequickbrown" * 40]
    for _ in range(2):
        assert counter.count(texts).tolist() == [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_chat_format(spark):
    trap = "\\### Assistant: </turn> ok"
    hard = [trap, "####", "\\\\#/</turn></turn>\\", "##\\#", None, "", "plain\ntext", "#\\#", "<\\/turn>"]
    data = [(1, k, "user" if k % 2 == 0 else "assistant", t, "c") for k, t in enumerate(hard + ["end"])]
    data += [(2, 0, None, "x", "c"), (2, None, "a:b\\c#/", None, "c"), (None, 0, "user", "q", "c"), (3, 0, "user", "b", "c"), (3, 0, "user", "a", "c"), (3, 0, "user", "a", "c"), (4, 0, "system", "s", "c"), (4, 1, "user", "u", "c"), (4, 2, "assistant", "v", "c")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, segments string")
    chats = chat_format.format_chats(turns)
    got = {r["conv_id"]: r for r in collect(chats)}
    digest = {r["conv_id"]: r for r in collect(chat_format.digests(chats))}
    order = lambda v: (v is not None, v)
    for conv in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == conv), key=lambda d: (order(d[1]), order(d[2]), order(d[3])))
        told = "".join(f"{d[2] or ''}\n{d[3] or ''}\n" for d in own)
        lost = "".join(d[3] or "" for d in own if d[2] == "assistant")
        r = digest[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(told.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
        assert r["formatted_chars"] == len(got[conv]["formatted"])
        assert got[conv]["formatted"].count("### ") == got[conv]["formatted"].count("</turn>") == len(own)
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert chat_format.digests(chat_format.format_chats(turns.where("false"))).count() == 0


def test_chat_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.digests(chat_format.format_chats(turns))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_jaccard(rows, width, num, den):
    word, sets = re.compile(r"[^\x20\x09-\x0d]+"), {}
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = word.findall(low)
        s = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        sets.setdefault(r[0], s)
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: len(sets[i]) for i in ids}, label


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard(docs, none, rows, width, num, den):
    sizes, label = brute_jaccard(rows, width, num, den)
    out = collect(jaccard.join(docs, width=width, num=num, den=den))
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], label[r["doc_id"]])
    assert len(set(label.values())) < len(label) - 20
    assert jaccard.join(none).count() == 0
    kept = collect(jaccard.one_of_each(docs, width=width, num=num, den=den))
    assert set(kept[0]) == set(docs.columns)
    with_words = [r["doc_id"] for r in kept if r["doc_id"] is not None and sizes[r["doc_id"]]]
    assert set(with_words) <= {i for i in label if sizes[i]} and len(with_words) == len(set(with_words))
    groups = {label[i] for i in label if sizes[i]}
    assert groups - {label[i] for i in with_words} <= {0}  # the group of document 0 also has a row without id
    assert {r["doc_id"] for r in kept} >= {i for i in label if not sizes[i]}


@pytest.mark.parametrize("n", [20, 100])
def test_jaccard_counts_every_link(spark, n):
    """Different texts that are all near each other link all with all, not only with one of them."""
    rnd = random.Random(n)
    base = [f"w{k}" for k in range(n)]
    texts = [" ".join([*base, x]) for x in ("red", "green", "blue", "white")] + [" ".join(rnd.sample(base, n))]
    out = {r["doc_id"]: r["n_links"] for r in collect(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert out == {0: 3, 1: 3, 2: 3, 3: 3, 4: 0}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_links_by_brute_force(spark, width, num, den):
    rnd = random.Random(9)
    texts = []
    for _ in range(12):
        w = prose(rnd, rnd.choice([5, 9, 14, 22, 40, 90])).split()
        for _ in range(6):
            v = list(w)
            for k in rnd.choice([(), (1,), (1,), (1, 2)]):
                v[-k] = rnd.choice(WORDS)
            texts.append(" ".join(v[: len(v) - rnd.choice([0, 0, 1])]))
    sets = [frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) for w in map(str.split, texts)]
    classes = set(sets)
    want = {i: sum(x != s and den * len(x & s) >= num * len(x | s) for x in classes) for i, s in enumerate(sets)}
    out = {r["doc_id"]: r["n_links"] for r in collect(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=width, num=num, den=den))}
    assert out == want and max(want.values()) > 2


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_of_families_by_brute_force(spark, monkeypatch, width, num, den):
    """Long lists: near copies of one text beside unrelated texts that share a passage, over several pieces and bands."""
    monkeypatch.setattr(jaccard, "LONG", 5)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base, passage, texts = [word() for _ in range(60)], [word() for _ in range(40)], []
    for k in range(50):
        v = [*base, *(word() for _ in range(rnd.randrange(12)))]
        for _ in range(rnd.randrange(3)):
            v[rnd.randrange(len(v))] = word()
        texts.append(" ".join(v))
        texts.append(" ".join([*passage, *(word() for _ in range(rnd.choice([2, 3, 20])))]))
    sets = [frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) for w in map(str.split, texts)]
    want = {i: sum(x != s and den * len(x & s) >= num * len(x | s) for x in set(sets)) for i, s in enumerate(sets)}
    out = {r["doc_id"]: r for r in collect(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=width, num=num, den=den))}
    _, label = brute_jaccard(list(enumerate(texts)), width, num, den)
    assert {i: r["n_links"] for i, r in out.items()} == want and max(want.values()) > 8
    assert {i: r["component_id"] for i, r in out.items()} == label


@pytest.mark.parametrize("rare", [2, 5, 48])
def test_shared_counts(monkeypatch, rare):
    monkeypatch.setattr(jaccard, "RARE", rare)
    rnd = np.random.default_rng(2)
    sets = [rnd.choice(60, rnd.integers(0, 30), replace=False) for _ in range(20)]
    got = jaccard.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_jaccard_lead_bound():
    """A set whose extra items lead still finds the set inside it."""
    rule = jaccard.Rule(90, 100)
    assert rule.holds(100, 100, 110) and not rule.holds(99, 100, 111)
    for n in range(1, 400):
        assert all(not rule.holds(rule.least(n) - 1, n, m) for m in range(rule.least(n), n + 1))


def test_mixing(docs, none, rows, spark):
    word = re.compile(r"[^\x20\x09-\x0d]+")
    out = collect(mixing.mixed(docs, common.Scratch(spark)))
    again = collect(mixing.mixed(docs.repartition(5), common.Scratch(spark)))
    key = lambda r: tuple((v is not None, v) for v in r.values())
    assert sorted(out, key=key) == sorted(again, key=key)
    size = {i: len(word.findall(t)) for i, t in texts_of(rows).items()}
    assert len(out) == len(rows)
    by_source: dict = {}
    for r in rows:
        by_source[r[3]] = by_source.get(r[3], 0) + len(word.findall(r[1] or ""))
    want = mixing.targets(by_source, mixing.cyclic_weights(list(by_source)), 3)
    source = {r[0]: r[3] for r in rows}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["times"] * r["size"]
        if r["doc_id"] is not None:
            assert r["size"] == size[r["doc_id"]]
            assert r["source_size"] == by_source[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
    assert sum(want.values()) == pytest.approx(sum(by_source.values()))
    assert mixing.mixed(none, common.Scratch(spark)).count() == 0
    taken = mixing.repeated(docs, common.Scratch(spark))
    assert taken.columns == docs.columns and taken.count() == sum(r["times"] for r in out)


def test_targets_stop_at_the_cap():
    got = mixing.targets({"a": 10, "b": 10, "c": 980}, {"a": 1, "b": 2, "c": 1}, 3)
    assert got == {"a": 30.0, "b": 30.0, "c": 940.0}
    assert mixing.cyclic_weights(["b", None, "a", "é"]) == {"a": 1, "b": 2, "é": 3, None: 1}


def test_route_overlapping_sources():
    capacity = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    flow = mixing.route(capacity, {"a": 120, "b": 60}, 3)
    assert flow[("a",), "a"] + flow[("a", "b"), "a"] == 120 and flow[("b",), "b"] + flow[("a", "b"), "b"] == 60
    # 160 words serve 180: 20 words are second passes, none is a third
    assert sum(max(0, sum(v for (p, _), v in flow.items() if p == q) - n) for q, n in capacity.items()) == 20


def test_mixing_of_many_sources(spark):
    """More sources than any number the driver would route one by one, and groups routed apart as together."""
    n = 25_000
    d = spark.range(n).selectExpr("id AS doc_id", "concat('s', id) AS source", "'a b c d' AS text")
    out = mixing.mixed(d, common.Scratch(spark), weights=lambda names: dict.fromkeys(names, 1))
    assert [tuple(r) for r in out.selectExpr("count(*)", "min(taken)", "max(taken)").collect()] == [(n, 4, 4)]
    capacity = {("a",): 100, ("a", "b"): 50, ("b",): 10, ("c",): 30, ("d", "e"): 20, ("e",): 5}
    quota = {"a": 120, "b": 60, "c": 200, "d": 30, "e": 20}
    one, apart = mixing.route_group(capacity, quota, 3), mixing.route(capacity, quota, 3)
    total = lambda flow, s: sum(v for (_, x), v in flow.items() if x == s)
    taken = lambda flow, p: sum(v for (x, _), v in flow.items() if x == p)
    price = lambda flow: sum(sum(max(0, taken(flow, p) - k * m) for k in range(1, 3)) for p, m in capacity.items())
    assert all(total(one, s) == total(apart, s) for s in quota) and price(one) == price(apart)


def test_mixing_overlap(spark):
    rnd = random.Random(5)
    data = [(k, [["a"], ["b", "a"], ["b"], None][k % 4], prose(rnd, rnd.randint(1, 40))) for k in range(400)]
    df = spark.createDataFrame(data, "doc_id long, source array<string>, text string")
    out = collect(mixing.mixed(df, common.Scratch(spark)))
    assert abs(sum(r["taken"] for r in out) - sum(r["size"] for r in out)) < 60


def test_audio(docs, none, rows):
    s = audio.Settings()
    out, own = collect(audio.media(docs, s)), texts_of(rows)
    assert len(out) == len(rows)
    same: dict = {}
    for r in out:
        assert same.setdefault(r["payload_sha256"], (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"])
        if r["doc_id"] is not None:
            raw = own[r["doc_id"]].encode()
            pay = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
            assert audio.read_wav(bytes(r["media"])) == (pay, s.rate)
            assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
            assert len(r["tensors"]) == len(r["spans"]) == -(-r["n_frames"] // s.tensor_frames)
            assert all(len(t) == s.tensor_frames * s.mels for t in r["tensors"])
    assert audio.media(none).count() == 0


def test_tensors_of_fixed_shape(spark):
    s = audio.Settings()
    d = spark.createDataFrame([(0, "a short text"), (1, "long " * 3000), (2, None)], "doc_id long, text string")
    table = audio.media(d).select("tensors").toArrow()
    got = audio.tensor_array(table["tensors"].combine_chunks())
    blocks = [t for x in table["tensors"].to_pylist() for t in x]
    assert list(got.type.shape) == [s.tensor_frames, s.mels] and len(got) == len(blocks) > 3
    assert np.array_equal(got.to_numpy_ndarray().reshape(len(blocks), -1), np.array(blocks, np.float32))


def test_resampling_is_filter_and_decimation():
    s = audio.Settings()
    x = np.random.default_rng(0).integers(-128, 128, 999)
    up = np.zeros(len(x) * s.up, np.int64)
    up[:: s.up] = x
    full = np.convolve(up, s.phases[:, ::-1].T.reshape(-1))
    assert (audio.resample(x, s) == (full[12 : 12 + len(up)][:: s.down] + 2048) >> 12).all()


def test_segments_have_hysteresis():
    s = audio.Settings(on=0.6, off=0.3)
    assert audio.segments(np.array([0, 70, 40, 20, 40, 100, 50, 10]), s) == [(1, 3), (5, 7)]


def test_html(spark):
    page = """<title>no</title><style>.h{display:none}</style><p>One <b>two</b>
three<p class=h>no<p>next<br>line &amp; more<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><th>Name<th>V<tr><td>longer<td>1</table><div hidden>no</div><script>no</script>end"""
    want = "One two three\n\nnext\nline & more\n\n- a\n- b\n  - c\n\nName    V\nlonger  1\n\nend"
    assert html_text.render(page) == want
    assert html_text.render("<div>" * 5000 + "deep") == "deep"
    data = [(1, page, "x"), (2, None, "x"), (None, "", None), (3, "a<b", "x"), (3, "a<b", "x"), (4, "<table><td>x<td>y</table>z", "x")]
    got = [(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(data, "page_id long, html string, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, want), (2, ""), (None, ""), (3, "a<b"), (3, "a<b"), (4, html_text.render(data[5][1]))], key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_text_of_odd_tables_and_styles():
    for page in ("<table><form><tr><td>x<td>y</tr></form></table>", "<table><tr><td>x</td><td>y</td></tr></table>"):
        assert html_text.render(page) == "x  y"
    for page in ("<table><center><tr><td>x<td>y</table>", "<tr><td>x<td>y</tr>", "<tbody><tr><td>x<td>y</tr></tbody>", "<table><tr><div>x</div><td>y</table>", "<table><tbody><div>x</div><tr><td>y</table>"):
        assert html_text.render(page).split() == ["x", "y"], page
    style = "<style>/* } */ @import url(a); @media print{.a{color:red}.b{display:none}} @media screen{.c{display:none}} .d{display:none} .a{color:red;.x{display:none}}</style>"
    assert html_text.render(style + "<p class=a>a</p><p class=b>b</p><p class=c>c</p><p class=d>d</p>") == "a\n\nb"


def test_deobfuscation():
    text = ["idiot moron pathetic stupid clown loser scum"] * 300
    model = toxicity.CharModel(toxicity.trigram_counts(text, toxicity.class_of_letters()))
    for token, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiot", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("p@thet1c", "pathetic"), ("lo-ser", "loser")):
        assert word in toxicity.restored_words(token, model)
    assert toxicity.restored_words("plain words", model) == {"plain", "words"}
    # mostly look-alikes, spaced out beside punctuation or by several blanks, stretched beyond any length
    for token, word in (("1d107", "idiot"), ("$(um", "scum"), ("s c u m.", "scum"), ('"s c u m"', "scum"), ("s  c  u  m", "scum"), ("so,i d i o t!", "idiot"), ("idi" + "o" * 100 + "t", "idiot"), ("1d1" + "0" * 60 + "t", "idiot")):
        assert word in toxicity.restored_words(token, model)
    for token in ("1,500", "$500", "15/08/1999", "45"):
        assert not toxicity.doubtful(token)
    assert len(model.decode("lo-ser" * 20_000)) > 80_000


def labelled(spark, n=800):
    rnd = random.Random(9)
    data = []
    for k in range(n):
        w = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(30)]
        toxic, bad = k % 8 == 0, k % 9 == 0
        if toxic:
            w[5:8] = ["blorghead", "bl0rghead", "zz"]
        text = " ".join(x.upper() + "!!" if bad else x for x in w)
        data.append((k, text, "en", "s", len(text), int(toxic), int(not bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, toxic int, quality int")
    return df.drop("toxic", "quality"), df.select("doc_id", "toxic", "quality")


def test_toxicity(spark, docs, none, rows):
    d, labels = labelled(spark)
    out = {r["doc_id"]: r for r in collect(toxicity.scores(d, labels))}
    held = [(out[r.doc_id]["predicted"], r.toxic) for r in labels.collect() if out[r.doc_id]["held_out"]]
    assert len(held) > 100 and all(a == b for a, b in held)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    some = labels.union(labels.select(F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("int")))
    got = collect(toxicity.scores(docs, some))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scores(none, labels).count() == 0
    assert toxicity.scores(docs, labels.where("false")).count() == len(rows)
    clean = toxicity.without_toxic(d, labels)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, r in out.items() if not r["predicted"]}


def test_quality(spark, docs, none, rows):
    d, labels = labelled(spark)
    trusted = labels.where("quality = 1").select("doc_id")
    out = collect(quality.classify(d, trusted))
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert {r["doc_id"] for r in out if not r["kept"]} == bad
    # the joined path gives what the broadcast path gives
    joined = {r["doc_id"]: r["perplexity"] for r in collect(quality.classify(d, trusted, broadcast_grams=0))}
    assert all(joined[r["doc_id"]] == pytest.approx(r["perplexity"], rel=1e-4) for r in out)
    got = collect(quality.classify(docs, trusted))
    assert len(got) == len(rows) and all(r["kept"] for r in got if not r["chars"])
    assert quality.classify(none, trusted).count() == 0
    assert all(r["kept"] for r in collect(quality.classify(docs, trusted.where("false"))))
    good = quality.keep_good(d, trusted)
    assert good.columns == d.columns and {r.doc_id for r in good.collect()} == {r["doc_id"] for r in out if r["kept"]}


def test_quality_in_slices(spark, monkeypatch):
    """N-grams that are too many to be sent at once are sent in slices: documents are not joined to them."""
    d, labels = labelled(spark)
    trusted = labels.where("quality = 1").select("doc_id")
    want = {r["doc_id"]: r["perplexity"] for r in collect(quality.classify(d, trusted))}
    costs = spark.range(1000).selectExpr("id * 104729 as gram", "cast(id % 7 as float) as cost")
    parts = quality.told_costs(costs, 300)
    assert len(parts) == 4 and sum(len(p.told.value[0]) for p in parts) == 1000 and all(0 < len(p.told.value[0]) < 400 for p in parts)
    monkeypatch.setattr(quality, "told_costs", lambda costs, n: [quality.Costs(costs, k, 3) for k in range(3)])
    assert {r["doc_id"]: r["perplexity"] for r in collect(quality.classify(d, trusted))} == pytest.approx(want)
    plan = quality.keep_good(d, trusted)
    assert plan.columns == d.columns and plan.count() == quality.classify(d, trusted).where("kept").count()


def test_quality_of_a_rare_language(spark):
    """A language of few trusted texts has a threshold of its own, not that of a frequent one."""
    rnd = random.Random(4)
    noise = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=300))
    data = [(k, noise(), "zz") for k in range(160)] + [(k, prose(rnd, 60), "en") for k in range(160, 200)]
    bad = [(k, noise(), "en") for k in range(200, 210)]
    d = spark.createDataFrame(data + bad, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in collect(quality.classify(d, d.where("doc_id < 200").select("doc_id")))}
    assert out[160]["threshold"] < out[0]["threshold"] / 2
    assert not any(out[r[0]]["kept"] for r in bad) and all(out[k]["kept"] for k in range(160, 200))


def test_kneser_ney_by_hand(spark):
    """Against interpolated Kneser-Ney written out with dictionaries, for order 3."""
    texts, order = ["abracadabra", "barbara", "cab"], 3
    codes = [int(x) for t in texts for x in quality.gram_codes([t], order)[0]]
    mask = lambda k: (1 << quality.BITS * k) - 1
    top: dict = {}
    for c in codes:
        top[c] = top.get(c, 0) + 1
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for g in {c & mask(k + 1) for c in top}:
            levels[k][g & mask(k)] = levels[k].get(g & mask(k), 0) + 1
    d = {k: quality.discounts(*(sum(v == i for v in level.values()) for i in (1, 2, 3, 4))) for k, level in levels.items()}

    def p(g, k):
        if k == 0:
            return 1 / (quality.DIRECT + 512)
        level, context = levels[k], g >> quality.BITS
        under = {x: n for x, n in level.items() if x >> quality.BITS == context}
        if not under:
            return p(g & mask(k - 1), k - 1)
        cut = lambda n: d[k][min(n, 3) - 1]
        n = level.get(g, 0)
        return ((n - cut(n) if n else 0) + sum(map(cut, under.values())) * p(g & mask(k - 1), k - 1)) / sum(under.values())

    scratch = common.Scratch(spark)
    counts = scratch.save(spark.createDataFrame(list(top.items()), "gram long, n long"))
    own, contexts = quality.train(counts, scratch, order)
    asked = [int(x) for x in quality.gram_codes(["abracadabra zebra"], order)[0]]
    got = {r.gram: r.cost for r in quality.resolve(spark.createDataFrame([(x,) for x in set(asked)], "gram long"), own, contexts, order).collect()}
    for g in asked:
        assert got[g] == pytest.approx(-np.log(p(g, order)))


def test_embed_dups(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[:200] = x[0] + rng.normal(size=(200, 16)) * 0.04
    x[300:340] = x[300] + rng.normal(size=(40, 16)) * 0.15
    x[500] = x[501] = x[502]
    data = [(int(k), [float(v) for v in np.float32(row)], 1) for k, row in enumerate(x)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0] * 15 + [None], 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, [float("inf")] * 16, 1), (2005, [], 1), (2006, [1.0] * 3, 1), (None, data[0][1], None), data[7]]
    df = spark.createDataFrame([*data, *odd], "vec_id long, embedding array<float>, c int")
    out = collect(embed_dups.near_dups(df))
    assert len(out) == len(data) + len(odd)
    u = np.array([d[1] for d in [*data, data[0], data[7]]], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.append(np.arange(1500), [0, 7])
    for _ in range(1500):
        new = np.minimum(label, np.where(link, label[None, :], 9999).min(1))
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in out if r["vec_id"] is not None}
    true = link.sum(1)[:1500]
    found = np.array([got[k]["n_links"] for k in range(1500)])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum()
    assert [got[k]["component_id"] for k in range(1500)] == label[:1500].tolist()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(2000, 2007))
    assert embed_dups.audit_recall(df, embed_dups.near_dups(df), every=10) >= 0.9
    assert embed_dups.near_dups(df.where("false")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert common.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark)).count() == 0


def test_pipeline(spark, docs, none, tmp_path):
    import corpus_pipeline

    d, labels = labelled(spark, 400)
    rough = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 10_000)
    d.union(rough).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, frame.where("false"), str(tmp_path)).count() == 0
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or new.columns == frame.columns
        frame = new
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    left = {r.doc_id for r in frame.select("doc_id").collect()}
    assert left and not left & toxic
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))


TEMPLATES = {
    "chatml": chat_format.Template(head="<|im_start|>", middle="\n", tail="<|im_end|>\n"),
    "inst": chat_format.Template(head="[", middle="] ", tail="\n\n\n#"),
    "bars": chat_format.Template(head="||", middle="|", tail="||||;"),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_chat_templates(spark, name):
    """Texts and roles that hold the marks of a template come back as they were."""
    t = TEMPLATES[name]
    marks = [t.head, t.middle, t.tail, t.tail.strip(), "\\", "\\c", "<", "|", "||", "|||", "#", "\n", "c", "/"]
    rnd, turns = random.Random(4), []
    for conv in range(150):
        for k in range(4):
            text = "".join(rnd.choice([*marks, "ok", " "]) for _ in range(rnd.randrange(9)))
            role = rnd.choice(["user", "assistant"]) + "".join(rnd.choice(marks) for _ in range(rnd.choice([0, 0, 1, 3])))
            turns.append((conv, k, role, text))
    turns.append((999, 0, "user", f"hi{t.tail}{t.head}assistant{t.middle}forged"))
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(frame, t)
    back = {r.conv_id: [tuple(x) for x in r.back] for r in chats.select("conv_id", chat_format.read_back(F.col("formatted"), t).alias("back")).collect()}
    want = {}
    for conv, _, role, text in turns:
        want.setdefault(conv, []).append((role, text))
    assert back == want
    lost = {r["conv_id"]: r["loss_sha256"] for r in collect(chat_format.digests(chats, t))}
    assert lost[3] == hashlib.sha256("".join(x for r, x in want[3] if r == "assistant").encode()).hexdigest()


def test_chat_template_that_cannot_be_told_apart():
    for bad in (chat_format.Template(tail="##"), chat_format.Template(middle=""), chat_format.Template(head="\\x")):
        with pytest.raises(ValueError):
            chat_format.escape(F.lit("x"), bad)


def test_html_of_hostile_pages_takes_linear_time_and_space():
    import time

    began = time.time()
    assert html_text.render("<p><button>" + "<div>" * 100_000 + "deep") == "deep"
    assert html_text.render("<table><tr>" * 20_000 + "<td>in") == "in"
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>b</tr>" + "<tr><td>a<td colspan=900>b<td>c</tr>" * 2_000 + "</table>"
    out = html_text.render(wide)
    assert len(out) < 3 * len(wide) and out.count("a  b") == 2_000 and "w" * 20_000 in out
    big = "<p>word <b>bold</b> &amp; more</p><ul><li>one<li>two</ul>" * 20_000
    assert html_text.render(big).count("word bold & more") == 20_000
    assert time.time() - began < 60


def test_html_styles():
    sheet = "<style>p.h{display:none} .a .b{display:none} div#x.y > i{visibility:hidden} u.v b{display:none} a:hover{display:none}</style>"
    page = sheet + "<p class=h>1</p><div class=h>2</div><div class=a><span class=b>3</span></div><span class=b>4</span><div id=x class='y z'><i>5</i><b><i>6</i></b></div><u class=v><b>7</b></u><a>8</a>"
    assert html_text.render(page).split() == ["2", "4", "6", "8"]
    assert html_text.render("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>") == "yes"
    assert html_text.render("<div style='display:none'>no<b style='visibility: visible'>no</b></div>") == ""


def test_stored_tensors():
    s = audio.Settings()
    mel = np.random.default_rng(1).random((s.tensor_frames + 3, s.mels))
    blocks, spans = audio.tensors(mel, s)
    back = audio.read_tensors(audio.write_tensors(blocks, s))
    assert back.shape == blocks.shape == (2, s.tensor_frames, s.mels) and (back == blocks).all() and len(spans) == 2
    assert audio.feature(back, len(mel), []) == hashlib.sha256(np.round(mel.astype(np.float32) * 64).astype("<i2").tobytes()).hexdigest()
