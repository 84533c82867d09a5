"""The registered queries of the training-data operators as they are registered: columns, types, rows, and what a second look at the tables says."""

import hashlib
import zlib

import numpy as np
import oracle
import pytest

from tessella.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op2_fingerprints": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op3_embedding_near_dedup": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op4_private_spans": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op5_main_text": "page_id:bigint url:string text:string n_chars:bigint",
    "op7_best_fit_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op8_token_files": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op9_repeated_passages": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op10_ngram_join": "doc_id:bigint n_shingles:bigint component_id:bigint",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def results(spark):
    kept = {}

    def get(name):
        if name not in kept:
            df = QUERIES[name](spark, FOLDER)
            kept[name] = (df.dtypes, df.collect())
        return kept[name]

    return get


@pytest.mark.parametrize("name", sorted(COLUMNS, key=lambda n: int(n[2:].split("_")[0])))
def test_columns_and_rows(results, spark, texts, name):
    kinds, rows = results(name)
    own = [tuple(x.split(":")) for x in COLUMNS[name].split()]
    assert kinds[: len(own)] == own
    key = own[0][0]
    if key == "doc_id":
        assert {r[key] for r in rows} == set(texts) and (name.startswith("op7") or len(rows) == len(texts))
    else:
        table = {"vec_id": "embeddings", "page_id": "pages"}[key]
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), ORACLE_SQL[name]) == ""


def test_toxicity_query(results):
    _, rows = results("op1_toxicity")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_fingerprint_query(results, texts):
    _, rows = results("op2_fingerprints")
    own = sorted(texts)
    after = dict(zip(own, own[1:] + own[:1]))
    for r in rows:
        t, n = texts[r["doc_id"]], len(texts[r["doc_id"]])
        edited = t[: n - n // 4] + texts[after[r["doc_id"]]][: n // 4]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def plain_base(text):
    """Base spans by walking over the text, without regular expressions."""
    out, n = [], len(text)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    digit = "0123456789"

    def run(i, own):
        while i < n and text[i] in own:
            i += 1
        return i

    i = 0
    while i < n:  # email
        j = run(i, alnum + "._%+-")
        if j > i and j < n and text[j] == "@":
            k, end = run(j + 1, alnum + "-"), None
            while k > j + 1 and k < n and text[k] == "." and (m := run(k + 1, alnum + "-")) > k + 1:
                k = end = m
            if end:
                out.append((i, 0, end))
                i = end
                continue
        i = max(j, i + 1) if not (j < n and text[j] == "@") else j + 1
    i = 0
    while i < n:  # ip: the longest runs of digits, else one further on
        j, at, ends = i, i, []
        while len(ends) < 4 and (k := run(at, digit)) > at:
            ends.append((at, k))
            at = k + 1
            if k >= n or text[k] != ".":
                break
        if len(ends) == 4:
            if all(int(text[a:b]) <= 255 for a, b in ends):
                out.append((i, 1, ends[-1][1]))
            i = ends[-1][1]
        else:
            i = j + 1
    i = 0
    while i < n:  # card
        if text[i] not in digit:
            i += 1
            continue
        end, j = i + 1, i + 1
        while j < n and (text[j] in digit or text[j] in " -" and j + 1 < n and text[j + 1] in digit):
            j += 1 if text[j] in digit else 2
            end = j
        found = [int(c) for c in text[i:end] if c in digit]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(found)))
        if 12 <= len(found) <= 19 and total % 10 == 0:
            out.append((i, 2, end))
        i = end
    i = 0
    while i < n:  # phone
        if text[i] == "+" and i + 1 < n and text[i + 1] in digit:
            j = run(i + 2, digit + " ().-")
            while j > i + 2 and text[j - 1] not in digit:
                j -= 1
            if j > i + 3:
                if 9 <= sum(c in digit for c in text[i:j]) <= 15:
                    out.append((i, 3, j))
                i = j
                continue
        i += 1
    return sorted(out)


def test_private_query(results, texts):
    _, rows = results("op4_private_spans")
    kinds = ("email", "ip", "card", "phone")
    some = 0
    for r in rows:
        own = plain_base(texts[r["doc_id"]])
        said = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in own)
        some += bool(own)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{x}"] for x in kinds] == [sum(k == j for _, k, _ in own) for j in range(4)]
        assert set(said.split(",")) - {""} <= set(r["spans"].split(",")) and r["n_spans"] == len([x for x in r["spans"].split(",") if x])
    assert some


def test_packing_query(results, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, rows = results("op7_best_fit_packing")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    ends = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] <= 2048 and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and sum(b for _, b in own) <= 2048


def test_token_query(results, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, rows = results("op8_token_files")
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = np.array([*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_repeats_query(results, texts):
    _, rows = results("op9_repeated_passages")
    count = {}
    for i, t in texts.items():
        b = t.encode()
        for k in range(len(b) - 399):
            h = hash(b[k : k + 400])
            count[h] = count.get(h, 0) + 1
    for r in rows:
        b = texts[r["doc_id"]].encode()
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if count[hash(b[k : k + 400])] > 1:
                cover[k] += 1
                cover[k + 400] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) and r["n_chars"] == len(r["text"])
