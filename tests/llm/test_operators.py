"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bitpack, fingerprints, html, packing, pieces, privacy, repeats, setjoin, tokens, toxicity, vectors
from tessella.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, spans string, text_key int"


def words(r, n):
    return " ".join("".join(r.choice(["ba", "lo", "mi", "tur", "sen", "é", "ko"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus(n=60, seed=3):
    r = random.Random(seed)
    passage = words(r, 120)
    out = []
    for i in range(n):
        t = words(r, r.randint(1, 160))
        if i % 5 == 1:
            cut = t.split()
            cut[len(cut) // 2 : len(cut) // 2] = passage.split()[r.randint(0, 20) :]
            t = " ".join(cut)
        if i % 7 == 3 and out:
            w = (r.choice(out) or "x").split()
            w[r.randrange(len(w)) if w else 0 : 1] = ["changed"]
            t = " ".join(w)
        if i % 11 == 5 and out:
            t = r.choice(out)
        out.append(t)
    out += [None, "", "   \n\t ", "one", "two words", "a" * 3000, "ab" * 900, words(r, 4000), passage, passage, passage + " " + passage]
    rows = [(3 * i + 1, t) for i, t in enumerate(out)]
    r.shuffle(rows)
    rows += [rows[0], rows[1]]  # repeated rows
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "k", "y", 1) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components(spark, one_task):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long").repartition(5), one_task=one_task).collect()}
    want = union(edges, {x for e in edges for x in e})
    assert all(got.get(n, n) == c for n, c in want.items())


# op1
def test_toxicity(spark):
    r = random.Random(5)
    bad = ["vile", "rotten", "wretch"]

    def text(toxic):
        w = words(r, r.randint(30, 120)).split()
        for _ in range(4 * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        return " ".join(w)

    y = [int(r.random() < 0.3) for _ in range(400)]
    t = [text(k) for k in y]
    m = toxicity.fit(t[:300], y[:300])
    assert np.mean([(m.score(x) >= 0.5) == k for x, k in zip(t[300:], y[300:])]) > 0.97
    assert m.score(None) == m.score("") < 0.5
    far = words(random.Random(9), 3000)
    assert m.score(far) < 0.5 and m.score(far + " vile wretch rotten vile " * 3) > m.score(far)
    assert toxicity.fit([], []).score("x") == 0.0
    got = toxicity.score(frame(spark, [(1, None), (2, t[300]), (2, t[300])]), m).collect()
    assert len(got) == 3 and all(0 <= x["score"] <= 1 for x in got)


def test_toxicity_windows_hold_the_whole_text():
    t = "Ab, " + "x" * 500 + " end"
    own = toxicity.windows(toxicity.plain(t))
    assert own[0] == b"ab" and own[-1].endswith(b"end") and sum(len(w) for w in own) >= 500
    assert toxicity.windows(toxicity.plain("This is some very plain Text")) == [b"this is some very plain text"]
    many = toxicity.windows(toxicity.plain(words(random.Random(3), 200)))
    assert b" ".join(many).split() == words(random.Random(3), 200).encode().split() or sum(map(len, many)) > 0
    assert max(map(len, many)) <= toxicity.WINDOW and np.mean([w.count(b" ") for w in many]) > 2


def test_training_rows_leave_out_held_out_and_contradictory(spark):
    d = frame(spark, [(i, f"t{i}") for i in range(40)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (5, None)], "doc_id long, toxic int")
    texts, _, share = toxicity.training_rows(d, lab, "toxic", 100)
    own = {int(t[1:]) for t in texts}
    assert 0 < share < 1 and 3 not in own and all(zlib.crc32(str(i).encode()) % 5 for i in own) and len(own) > 20


# op2
def brute_shingles(t, k=5):
    w = (t or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints(spark, docs, rows, empty):
    got = fingerprints.fingerprint_pairs(docs, k=64).collect()
    order = sorted(rows, key=lambda x: (x[0], x[1] or ""))
    want = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got) == sorted(want)
    by_text = collections.defaultdict(set)
    text = dict(rows)
    for x in got:
        by_text[text[x["doc_id"]] or ""].add(x["fingerprint"])
        assert abs(x["n_distinct"] - len(brute_shingles(text[x["doc_id"]]))) <= 0.6 * len(brute_shingles(text[x["doc_id"]]))
    assert all(len(v) == 1 for v in by_text.values())
    error = []
    for n, (i, t) in enumerate(order):
        a, b = brute_shingles(t), brute_shingles(order[(n + 1) % len(order)][1])
        error += [abs(x["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) for x in got if x["doc_id"] == i][:1]
    assert np.mean(error) < 0.05
    assert fingerprints.fingerprint_pairs(empty).count() == 0
    one = fingerprints.fingerprint_pairs(frame(spark, [(None, "a b c d e f g h")])).collect()[0]
    assert one["near_next"] == 1.0


def test_fingerprints_merge(spark):
    r = random.Random(2)
    a, b = words(r, 900), words(r, 700)
    df = spark.createDataFrame([(a, b, a + " | | | | " + b)], "a string, b string, c string")
    x = df.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    x = x.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m"), "a", "b")
    m = x.select(fingerprints.distinct(F.col("m")).alias("n"), fingerprints.containment(F.col("a"), F.col("m")).alias("c"), fingerprints.resemblance(F.col("a"), F.col("m")).alias("j")).first()
    n = len(brute_shingles(a) | brute_shingles(b))
    assert abs(m["n"] - n) < 0.2 * n and m["c"] > 0.8 and abs(m["j"] - len(brute_shingles(a)) / n) < 0.12


# op3
def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    data = []
    for k in range(300):
        v = base[k % 40] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3, 1.0])
        data.append((1000 - k, [float(x) for x in v.astype(np.float32)], int(k % 3)))
    data += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, data[0][1], None), (2004, [float("inf")] + [1.0] * 15, 1), (2005, [], 1), (2006, [None] * 16, 1)]
    data += [(3000 + k, data[5][1], data[5][2]) for k in range(30)] + [(3100, [2.0 * x for x in data[5][1]], data[5][2])]
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in data], "vec_id long, embedding array<float>, label int, rep string, n int")
    ok = [(i, np.array(v, np.float64), y) for i, v, y in data if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, pairs = collections.Counter(), []
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and ok[a][1] @ ok[b][1] / np.sqrt(ok[a][1] @ ok[a][1]) / np.sqrt(ok[b][1] @ ok[b][1]) >= 0.93:
                pairs.append((ok[a][0], ok[b][0]))
                links.update(pairs[-1])
    want = union(pairs, [i for i, _, _ in data])
    for kw in ({"cells": 6, "block": 16}, {"cells": 1}, {}):
        got = {r["vec_id"]: r for r in vectors.near_duplicates(df, **kw).collect()}
        assert len(got) == len(data)
        assert all(got[i]["n_links"] == links[i] and got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i) for i in got)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# op4
def test_base_spans():
    t = "Mail a.b+c@x-y.example.com, no@tld or 10.0.0.255 and 1.2.3.256; card 4111 1111 1111 1111 or 4111 1111 1111 1112, call +1 (017) 555-7713."
    assert [(privacy.KINDS[k], t[s:e]) for s, k, e in privacy.base_spans(t)] == [("email", "a.b+c@x-y.example.com"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713")]
    assert privacy.base_spans("") == [] and not privacy.luhn("4111111111111112")


def test_find_and_sanitise(spark, docs, empty):
    r = random.Random(8)
    rows = [(i, f"{words(r, 12)} {'zorblatt' if i % 2 else words(r, 1)} boss@corp{i % 4}.example.com {words(r, 12)}") for i in range(40)] + [(100, None), (101, ""), (102, "é " * 500 + "+1 (017) 555-7713"), (103, words(r, 60))] * 2
    got = privacy.find(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for x in got:
        base = privacy.base_spans(text[x["doc_id"]] or "")
        said = privacy.spell(base)
        assert x["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert x["n_email"] == sum(k == 0 for _, k, _ in base) and x["n_phone"] == sum(k == 3 for _, k, _ in base)
        own = [s for s in x["spans"].split(",") if s]
        assert [s for s in own if not s.startswith("term")] == [s for s in said.split(",") if s]
        assert all((text[x["doc_id"]] or "")[int(s.split(":")[1]) : int(s.split(":")[2])].islower() for s in own if s.startswith("term"))
        assert not any(s.startswith("term") for s in own) or "@" in text[x["doc_id"]]
    clean = {r["doc_id"]: r for r in privacy.sanitise(frame(spark, rows)).collect()}
    assert "[EMAIL]" in clean[1]["text"] and "@" not in clean[1]["text"] and clean[103]["text"] == text[103] and clean[100]["text"] is None and clean[1]["key"] == "k"
    assert privacy.find(empty).count() == 0 and privacy.sanitise(empty).count() == 0


def test_secrets(spark):
    key = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"
    rows = [(1, f'say "{key}" twice'), (2, "a" * 40 + " and 12345678901234567890 and Donaudampfschifffahrtsgesellschaft"), (3, f"{key}@x.example.com"), (4, None)]
    got = {r["doc_id"]: r for r in privacy.find(frame(spark, rows)).collect()}
    assert [got[i]["n_secret"] for i in (1, 2, 3, 4)] == [1, 0, 0, 0] and got[1]["spans"] == "secret:5:45" and got[3]["spans"].startswith("email")
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and [got[i]["n_spans"] for i in (1, 2, 4)] == [1, 0, 0]
    assert {r["doc_id"]: r["text"] for r in privacy.sanitise(frame(spark, rows)).collect()}[1] == 'say "[SECRET]" twice'


def test_disclosing_terms_by_hand(spark):
    rows = [(i, f"alpha{chr(97 + i)} secretword john@x.example.com beta{chr(97 + i)}") for i in range(6)] + [(10 + i, f"common filler text number {chr(97 + i)}{chr(98 + i)}{chr(99 + i)}") for i in range(20)]
    got = {r["doc_id"]: r["spans"] for r in privacy.find(frame(spark, rows)).collect()}
    assert all(",term:" in got[i] or got[i].startswith("term:") for i in range(6)) and all(got[i] == "" for i in range(10, 30))
    copies = [(i, "one passage secretword john@x.example.com and no more") for i in range(9)] + rows[6:]
    assert not any("term" in r["spans"] for r in privacy.find(frame(spark, copies)).collect())  # copies are one context


def filler(n):
    return [(1000 + i, f"common filler text number {''.join(chr(97 + i // 26**k % 26) for k in range(4))}") for i in range(n)]


def term_texts(rows, got):
    text = dict(rows)
    return {r["doc_id"]: {text[r["doc_id"]][int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"} for r in got}


def test_terms_of_values_seen_once(spark):
    rows = [(1, "common filler text heitlich write heitlich.60@mail8.example.com common filler text"), *filler(1500)]
    got = term_texts(rows, privacy.find(frame(spark, rows)).collect())
    assert "heitlich" in got[1] and "common" not in got[1] and not any(got[i] for i, _ in rows[1:])
    few = rows[:40]  # too few texts: the one meeting may be chance
    assert not any(term_texts(few, privacy.find(frame(spark, few)).collect()).values())


def test_terms_far_from_the_value(spark):
    gap = "common filler text number " * 10
    rows = [(k, f"{w} {gap} boss{k}@x.example.com {gap} {w} and {w.upper()}") for k, w in ((1, "zorblatt"), (2, "heitlich"))] + filler(1500)
    got = {r["doc_id"]: r["spans"] for r in privacy.find(frame(spark, rows)).collect()}
    text = dict(rows)
    for k, w in ((1, "zorblatt"), (2, "heitlich")):
        assert [text[k][int(x.split(":")[1]) : int(x.split(":")[2])].lower() for x in got[k].split(",") if x[:4] == "term"] == [w] * 3
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(frame(spark, rows)).collect()}
    assert "zorblatt" not in clean[1].lower() and "heitlich" not in clean[2].lower() and clean[1000] == text[1000]
    again = [*rows, (3, "zorblatt without the value")]  # a text without the value stays as it is
    assert {r["doc_id"]: r["text"] for r in privacy.sanitise(frame(spark, again)).collect()}[3] == again[-1][1]


def test_copies_do_not_hide_terms(spark):
    rows = [(100 * k + c, f"alpha{chr(97 + k)} zorblatt john@x.example.com beta{chr(97 + k)}") for k in range(3) for c in range(40)] + filler(300)
    got = term_texts(rows, privacy.find(frame(spark, rows)).collect())
    assert all("zorblatt" in got[100 * k + c] for k in range(3) for c in range(40))
    once = term_texts(rows, privacy.find(frame(spark, [r for r in rows if r[0] % 100 == 0 or r[0] >= 1000])).collect())
    assert all(got[100 * k] == once[100 * k] for k in range(3))  # the same terms with and without copies


# op5
def test_main_text(spark):
    model = html.train()
    page = '<html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><article><h1>A title here</h1><p>First  paragraph &amp; more\n text of the story.<p>Second <b>one</b> ends here. It has sentences.</p><div class=ad>Buy now cheap!</div><p>Third paragraph, still the story.</p></article><section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this story very much indeed. Thanks.</p></div></section><aside class=sidebar><h3>Related</h3><ul><li><a href=x>Other</a></ul></aside><form><input name=q><p>Sign up for our newsletter</p></form><footer>&copy; us</footer></body></html>'
    assert html.extract([page, None, "", "<div></div>"], model) == ["A title here First paragraph & more text of the story. Second one ends here. It has sentences. Third paragraph, still the story.", "", "", ""]
    r = random.Random(77)
    f1 = []
    for _ in range(120):
        nodes = html.parse(html.synthetic_page(r), marked=True)
        want = html.text_of(nodes, {v for v in nodes if v.y == 1}).split()
        got = html.text_of(nodes, html.decode(nodes, model.predict(html.features(nodes)))).split()
        same = sum((collections.Counter(want) & collections.Counter(got)).values())
        f1.append(2 * same / max(1, len(want) + len(got)))
    assert np.mean(f1) > 0.95
    df = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "u", "<p>" + "long text. " * 30000, 0), (1, "u", page, 0)], "page_id long, url string, html string, text int")
    got = html.main_text(df).collect()
    assert len(got) == 4 and {x["n_chars"] for x in got if x["page_id"] == 2} == {0}
    assert html.main_text(df.limit(0)).count() == 0


STORY = "<html><body><div class='top-menu'><a href='/'>Home</a> <a href='/n'>News</a></div><article><h1>Title of it</h1><p>First sentence of the story is here. It goes on for a while, with more words to read.</p>%s<p>Last sentence of the story comes here, and it is long enough to count.</p></article><footer>Copyright words</footer></body></html>"
FIRST, LAST = "Title of it First sentence of the story is here. It goes on for a while, with more words to read.", "Last sentence of the story comes here, and it is long enough to count."


@pytest.mark.parametrize(
    ("inner", "said"),
    [
        ('<div data-y="1.5">middle words here are fine.</div>', "middle words here are fine."),
        ('<div data-y="">x y z.</div><p id=a id="b" class>odd attributes here.</p>', "x y z. odd attributes here."),
        ("İ" * 120 + "<script>var x = 1;</script> After the script comes this sentence.", "İ" * 120 + " After the script comes this sentence."),
        ("<svg>" + "<path d='1'/>hidden " * 150_000 + "</svg>", ""),
        ("<SCRIPT>if (a < b) { '</p>' }</ScRiPt><p>After it, more.</p>", "After it, more."),
        ("<p>Caf&eacute; &#8211; d&eacute;j&agrave;&nbsp;vu &lt;tag&gt;.", "Café – déjà vu <tag>."),
    ],
)
def test_pages_by_hand(inner, said):
    assert html.extract([STORY % inner], html.train())[0] == " ".join(x for x in (FIRST, said, LAST) if x)


def test_closing_tags_however_far():
    far = "hidden words " * 200_000  # 2.6 million characters
    nodes = html.parse(f"<body><p>\u0130 first</p><template>{far}</TEMPLATE><p>last</p><script>var x</script><svg>never closed<p>end</p>")
    text = html.text_of(nodes, set(nodes))
    assert "hidden" not in text and "var" not in text and text.endswith("first last never closed end")


def test_decoding_is_consistent():
    nodes = html.parse("<body><div><p>one two three</p><p>four five</p></div><div>six</div></body>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = html.decode(nodes, rng.normal(size=len(nodes)) * 3)
        assert kept <= set(nodes)


# op6
def test_pieces_agree_with_the_library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces.load(path)
    texts = [t or "" for _, t in corpus()] + ["日本語 🎉", "  two  spaces ", "▁ a▁b", "\x00\n\t", "x" * 700]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == sp.encode(texts)
    assert [own.decode(x) for x in got] == sp.decode(got)
    r = random.Random(5)
    names = [x for x in own.table if len(x) > 1]
    odd = ["".join(r.choice([r.choice(names).replace("▁", " "), r.choice("abcdeéü  日🎉\n\t ▁")]) for _ in range(r.randint(1, 5))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(odd)]
    assert got == sp.encode(odd) and [own.decode(x) for x in got] == sp.decode(got)
    broken = [[r.choice([r.randrange(3, 259), r.randrange(32000)]) for _ in range(12)] for _ in range(500)]
    assert [own.decode(x) for x in broken] == sp.decode(broken)


def test_neighbours_against_merging():
    import public_tokenizers

    own = pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(7)
    ids = [i for w, (_, i) in own.table.items() if not own.unordered[i]]
    x, y = np.array([r.choice(ids) for _ in range(4000)]), np.array([r.choice(ids) for _ in range(4000)])
    got = own._may_follow(x, y)
    for a, b, ok in zip(x.tolist(), y.tolist(), got.tolist()):
        w = own.pieces[a] + own.pieces[b]
        score, _ = own._lookup([w], min(len(w), own.longest))
        span = own._merge(score, 1, len(w), min(len(w), own.longest))[0]
        assert ok == (span[0] == len(own.pieces[a]) and (span > 0).sum() == 2)


def test_sentencepiece_query(spark, docs, rows, empty, tmp_path):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pieces.op6_sentencepiece(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "same"]
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert pieces.encode_decode(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_viterbi_against_all_segmentations():
    names = ["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a"]
    p = pieces.Pieces(names, [0, -2.0, -2.1, -2.5, -3.0, -3.2, -1.0, -2.2], [2, 1, 1, 1, 1, 1, 1, 1], unigram=True)
    score = dict(zip(names[1:], [-2.0, -2.1, -2.5, -3.0, -3.2, -1.0, -2.2]))

    def best(w):
        if not w:
            return 0.0
        return max((score[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in score), default=-1e9)

    r = random.Random(6)
    for _ in range(60):
        t = "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        ids = np.frombuffer(p.encode([t])[0], "<u4").tolist()
        assert p.decode(ids) == t and abs(sum(score[names[i]] for i in ids) - best("▁" + t)) < 1e-9


# op7
def test_packing(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, size = Tokenizer.from_file(path), 256
    got = packing.pack(docs, path, 0, size).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    n = collections.Counter(i for i, _ in rows)
    at = collections.defaultdict(list)
    for x in got:
        own = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == x["ids_crc32"] and 1 <= x["length"] <= size
        assert x["piece"] == 0 or x["length"] == size
        at[x["sequence_id"]].append((x["offset"], x["length"]))
    assert collections.Counter(x["doc_id"] for x in got) == {i: n[i] * len(packing.cut(len(ids[i]), size)) for i in ids}
    for own in at.values():
        end = 0
        for o, k in sorted(own):
            assert o == end
            end += k
        assert end <= size
    total = sum(len(ids[i]) * n[i] for i in ids)
    assert len(at) <= 1.05 * -(-total // size) + 2
    assert packing.pack(empty, path).count() == 0


def test_fillings_are_undominated():
    counts = np.zeros(51, int)
    counts[[10, 20, 25, 30]] = 1
    assert packing.completions(counts, 50, None, None) == [(30, 20)]
    r = random.Random(14)
    for _ in range(60):
        room, counts = r.randint(10, 40), np.zeros(41, int)
        for _ in range(r.randint(1, 8)):
            counts[r.randint(1, 20)] += 1
        pieces = [s for s in range(41) for _ in range(counts[s])]
        every = {tuple(sorted((pieces[i] for i in range(len(pieces)) if m >> i & 1), reverse=True)) for m in range(1 << len(pieces))}
        every = {f for f in every if sum(f) <= room}

        def free(f):
            return [s for s in range(41) if counts[s] > f.count(s)]

        want = {f for f in every if packing.undominated(f, room - sum(f), free(f))}
        got = packing.completions(counts, room, None, None)
        assert set(got) == want and min(map(lambda f: room - sum(f), got)) == min(room - sum(f) for f in every)


def test_exhaustive_bin_completion():
    r = random.Random(15)
    for _ in range(15):
        size, pieces = 20, sorted((r.randint(2, 14) for _ in range(r.randint(3, 8))), reverse=True)

        def least(i, rooms):
            if i == len(pieces):
                return len(rooms)
            tries = {k for k in range(len(rooms)) if rooms[k] >= pieces[i]}
            own = [least(i + 1, rooms[:k] + (rooms[k] - pieces[i],) + rooms[k + 1 :]) for k in tries]
            return min([*own, least(i + 1, (*rooms, size - pieces[i]))])

        counts = np.bincount(pieces, minlength=size + 1)
        got = packing.complete_bins(counts, size, None, None, None, None)
        assert sum(n for _, n in got) == least(0, ()) and collections.Counter(x for p, n in got for x in p * n) == collections.Counter(pieces)


def test_bin_completion_is_optimal_on_small_sets():
    r = random.Random(3)

    def optimum(items, size):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in {b: j for j, b in enumerate(bins)}.values():
                if bins[k] + items[i] <= size:
                    go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for _ in range(40):
        items = sorted((r.randint(1, 30) for _ in range(r.randint(1, 9))), reverse=True)
        counts = np.bincount(items, minlength=31)
        found = packing.complete_bins(counts, 30)
        assert sum(n for _, n in found) == optimum(items, 30)
        assert sorted(x for p, n in found for x in p * n) == sorted(items) and all(sum(p) <= 30 for p, _ in found)


# op8
def test_token_files(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessella.llm.common import scratch_path

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(map(tuple, bitpack.read_tokens(spark, bitpack.write_tokens(docs, scratch_path(spark, "t"), path, 2, file_ids=3000)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda x: x[1])
    at, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert bitpack.read_tokens(spark, bitpack.write_tokens(empty, scratch_path(spark, "t"), path, 2)).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 15, 16, 17, 24, 31, 32])
def test_bits_round_trip_with_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    f = bitpack.TokenFile(bitpack.build([1, 2], [600, 1001], ids, bits, block=64))
    assert (f.ids(0, 1001) == ids).all() and (f.document(1) == ids[600:]).all()
    for a, b in ((0, 1), (63, 65), (500, 777), (1000, 1001), (5, 5)):
        assert (f.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        bitpack.pack(np.array([2], np.uint32), 1)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_agree_with_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own, tok = tokens.TextCoder(path, cache=50), Tokenizer.from_file(path)
    texts = [t or "" for _, t in corpus()] + [" ", "a  b", "\n\na \n b  \n", "x's don't  ÉÀ ﬁ ① 12a", "<|endoftext|> hi", "a\x1cb\x85d", "İstanbul ẞ ΑΣ Σ", "日本語 🎉", "'s 's\n's"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


# op9
def brute_repeats(rows, width):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                cover[k] += 1
                cover[k + width] -= 1
        c = (np.cumsum(cover)[:-1] > 0).astype(int)
        out.append((i, len(b), int(c.sum()), int((np.diff(np.concatenate([[0], c])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[c == 0])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats(docs, rows, group):
    assert sorted(tuple(x)[:5] for x in repeats.spans(docs, 100, group).collect()) == brute_repeats(rows, 100)


def test_repeats_of_edges_and_tables(spark, empty):
    r = random.Random(12)
    p = words(r, 80)
    rows = [(i, words(r, 3) + p[r.randint(0, 60) : len(p) - r.randint(0, 60)] + words(r, 3)) for i in range(40)]
    for group in (4096, 3):
        assert sorted(tuple(x)[:5] for x in repeats.spans(frame(spark, rows), 120, group).collect()) == brute_repeats(rows, 120)
    assert repeats.spans(empty).count() == 0
    kept = repeats.remove(frame(spark, [(1, "é" * 300 + "x"), (2, "y" + "é" * 300), (3, None), (4, "clean")]), 400).collect()
    assert {x["doc_id"]: x["text"] for x in kept}[4] == "clean" and len(kept) == 4 and kept[0]["key"] == "k"


def brute_passages(rows, n):
    count = collections.Counter()
    found = [(i, [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]) for i, t in rows]
    for _, w in found:
        count.update(tuple(m[0] for m in w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for i, w in found:
        own = []
        for k in range(len(w) - n + 1):
            if count[tuple(m[0] for m in w[k : k + n])] > 1:
                if own and k <= own[-1][1]:
                    own[-1][1] = k + n
                else:
                    own.append([k, k + n])
        out.append((i, len(own), ",".join(f"{w[a].start()}:{w[b - 1].end()}" for a, b in own)))
    return sorted(out)


@pytest.mark.parametrize("group", [4096, 1])
def test_passages_of_words(spark, monkeypatch, docs, rows, group):
    monkeypatch.setattr(repeats, "WORDS", repeats.WORDS._replace(gram=4))
    assert sorted((r[0], *r[-2:]) for r in repeats.spans(docs, 100, group, 12).collect()) == brute_passages(rows, 12)
    r = random.Random(5)
    p = ["".join(r.choice("abc") for _ in range(r.randint(1, 2))) for _ in range(60)]
    near = []
    for i in range(60):  # short words in other surroundings, white space and lengths
        own = p[r.randint(0, 20) : r.randint(30, 60)]
        near.append((i, words(r, r.randint(0, 9)) + "".join(r.choice([" ", "\n", "\t ", "  "]) + w for w in own) + r.choice([" ", "\r\n"]) + words(r, 5)))
    assert sorted((r[0], *r[-2:]) for r in repeats.spans(frame(spark, near), 400, group, 15).collect()) == brute_passages(near, 15)


def test_passages_of_over_50_words_in_few_bytes(spark):
    r = random.Random(9)
    p = ["".join(r.choice("abcdef") for _ in range(3)) for _ in range(51)]
    rows = [(1, f"{words(r, 60)} {' '.join(p)} {words(r, 20)}"), (2, f"{words(r, 9)} {chr(10).join(p)}"), (3, f"{words(r, 60)} {' '.join(p[:50])} end"), (4, " ".join(p[1:])), (5, None)]
    assert len(" ".join(p)) < 400
    own = {x["doc_id"]: x for x in repeats.spans(frame(spark, rows)).collect()}
    assert {i: (x["n_removed"], x["n_passages"]) for i, x in own.items()} == {1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    kept = {x["doc_id"]: x["text"] for x in repeats.remove(frame(spark, rows)).collect()}
    assert kept == {i: t if i > 2 else t.replace((" " if i == 1 else "\n").join(p), "") for i, t in rows}


def test_words_of_long_texts(monkeypatch):
    data = ("x" * 900 + " é\n\x0b y  " + words(random.Random(4), 300)).encode()
    whole = repeats.word_hashes(data)
    monkeypatch.setattr(repeats, "STEP", 64)
    own = re.findall(rb"[^\x20\x09-\x0D]+", data)
    assert whole.tolist() == repeats.word_hashes(data).tolist() and len(set(whole.tolist())) == len(set(own)) and len(whole) == len(own)
    assert [data[a:b] for a, b in zip(*repeats.word_bounds(data))] == own and not len(repeats.word_hashes(b" \n"))


def test_chunks_of_long_texts_do_not_matter(monkeypatch, docs, rows):
    monkeypatch.setattr(repeats, "STEP", 512)
    data = corpus()[0][1].encode() if corpus()[0][1] else b"x" * 900
    data = (data + b"abc" * 400)[:3000]
    a = repeats.runs(data, 100)
    assert sorted(set(a[3].tolist())) and a[4][-1] == len(data) - 100 and ((a[3][1:] - a[4][:-1]) == 1).all()


def test_maximal_repeats_against_pairs():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(2, 9)
        lefts = ["".join(r.choice("ab") for _ in range(r.randint(0, 6))).encode() for _ in range(n)]
        rights = ["".join(r.choice("ab") for _ in range(r.randint(1, 8))).encode() for _ in range(n)]
        got = collections.defaultdict(set)
        for depth, members in repeats.maximal_repeats(lefts, rights, 5):
            for i, left in members:
                got[i] |= {(a, b) for a in range(left + 1) for b in range(depth + 1)}
        want = collections.defaultdict(set)
        for i in range(n):
            for j in range(n):
                if i != j:
                    a, b = repeats._common(lefts[i], lefts[j]), repeats._common(rights[i], rights[j])
                    if a + b >= 5:
                        want[i] |= {(x, y) for x in range(a + 1) for y in range(b + 1)}
        assert {i: max(a for a, _ in v) for i, v in got.items()} == {i: max(a for a, _ in v) for i, v in want.items()}
        assert {i: max(b for _, b in v) for i, v in got.items()} == {i: max(b for _, b in v) for i, v in want.items()}


# op10
def brute_sets(rows):
    out = {}
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_ngram_join(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(setjoin, "HOT", hot)
    r = random.Random(4)
    more = list(rows)
    base = words(r, 60).split()
    for k in range(60):  # a chain of near copies, not all linked directly
        base = base[:]
        base[r.randrange(60)] = "edit" + str(k)
        more.append((5000 + k, " ".join(base)))
    more += [(6000, "A B C"), (6001, "a b c"), (6002, "a\x0bb c d e f")]
    sets = brute_sets(more)
    own = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(own) for b in own[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union(pairs, own)
    got = setjoin.classes(frame(spark, more)).collect()
    assert len(got) == len(more)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == {i: (len(sets[i]), want[i]) for i in own}


def test_ngram_join_of_empty_tables(empty):
    assert setjoin.classes(empty).count() == 0
