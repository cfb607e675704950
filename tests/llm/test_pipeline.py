import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def base_rules_keep(text):
    words = text.encode().split()
    seen = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    cover = {j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(words) >= 50 and 100 * len(cover) <= 50 * len(words)


def near_representatives(docs):
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if b < a and sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i: docs[i] for i in docs if label[i] == i}


def without_repeats(docs, size=50):
    places = {i: [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", t)] for i, t in docs.items()}
    windows = lambda i, p: tuple(docs[i][a:b] for a, b in places[i][p : p + size])
    many = collections.Counter(windows(i, p) for i in docs for p in range(len(places[i]) - size + 1))
    out, n_cut = {}, 0
    for i, t in docs.items():
        gone = {k for p in range(len(places[i]) - size + 1) if many[windows(i, p)] > 1 for k in range(p, p + size)}
        starts = [a for a, _ in places[i]] + [len(t)]
        left = t[: starts[0]] + "".join(t[starts[k] : starts[k + 1]] for k in range(len(places[i])) if k not in gone)
        n_cut += bool(gone)
        if left.split() or not gone:
            out[i] = left
    return out, n_cut


def test_every_stage_against_brute_force(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = {r["doc_id"]: r["text"] or "" for r in rows}
    assert len(docs) == len(rows)
    good = collections.Counter(r["lang"] for r in rows for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if x["doc_id"] == r["doc_id"] and x["quality"] == 1)
    assert max(good.values()) < 500  # too few for any cutoff: 0.99 ** n exceeds 0.05 / 4 / strata, so the base rules decide
    kept = {i: t for i, t in docs.items() if base_rules_keep(t)}
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    unique = {i: t for t, i in first.items()}
    near = near_representatives(unique)
    left, n_cut = without_repeats(near)
    assert len(docs) > len(kept) > len(unique) > len(near) >= len(left) and n_cut
    encode, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for i, t in left.items():
        ids = np.array(encode.encode(t, add_special_tokens=False).ids + [2], "<u4")
        at, end, piece = 0, len(ids) % 1024 or min(1024, len(ids)), 0
        while at < len(ids):
            want.add((i, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at, end, piece = end, end + 1024, piece + 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    spans = collections.defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for found in spans.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(spans) <= 1.05 * np.ceil(sum(r.length for r in got) / 1024) + 1
    assert "pipeline" in __spark_entry__.queries()


def planted(rnd, n_docs=300, n_passages=60):
    """(texts, passages, where, clean): passages of 51 to 70 words, each in two or three documents of which the first is where it comes from."""
    words = lambda n: " ".join("".join(rnd.choice("aeioustrnlmdk") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    texts = {i: words(rnd.randint(80, 400)) for i in range(n_docs)}
    passages, where, base = [], [], dict(texts)
    for _ in range(n_passages):
        home, *others = rnd.sample(range(n_docs // 2), rnd.choice([2, 3]))
        w, n = base[home].split(), rnd.randint(51, 70)
        at = rnd.randrange(len(w) - n)
        passage = " ".join(w[at : at + n])
        for i in others:
            texts[i] = f"{passage} {texts[i]}" if rnd.random() < 0.5 else f"{texts[i]} {passage}"  # never inside another one
        passages.append(passage)
        where.append([home, *others])
    return texts, passages, where, range(n_docs // 2, n_docs)


def test_planted_passages_are_caught_and_clean_documents_left_alone(spark, tmp_path):
    texts, passages, where, clean = planted(random.Random(21))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, docs, str(tmp_path)).collect()}
    caught = [all(p not in got.get(i, "") for i in w) for p, w in zip(passages, where, strict=True)]
    homes = {w[0] for w in where} - {i for w in where for i in w[1:]}
    assert sum(caught) == len(passages) and all(got[i] == texts[i] for i in clean)
    assert homes and all(len(got[i].split()) >= len(texts[i].split()) - sum(70 for w in where if w[0] == i) for i in homes if i in got)
    print(f"caught {sum(caught) / len(caught):.2f}, clean left alone {sum(got.get(i) == texts[i] for i in clean) / len(clean):.2f}, of documents that a passage only comes from left alone {sum(got.get(i) == texts[i] for i in homes) / len(homes):.2f}")


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(5, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = lambda mark, n=120: " ".join(f"{mark}{k}é" for k in range(n))
    good, near = text("a"), text("a", 118) + " p q"
    rows = [(5, good), (5, "too short"), (5, text("b")), (None, text("c")), (None, text("c")), (None, near), (None, None), (8, ""), (9, text("b")), (11, text("d") + " " + text("e", 200)), (12, text("e", 200) + " " + text("f"))]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, kept_text string, n_removed int, row_key string, kept boolean, stage_key int"
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "y", 1, "z", False, 7) for i, t in rows], names).repartition(3)
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs.write.parquet(f"{tmp_path}/in{k}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/in{k}"), str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    clean = [r for r in rows if r[1] and len(r[1]) > 20]
    assert sizes[0] == sorted(clean, key=str)
    once = [(5, good), (5, text("b")), (None, text("c")), (None, near), *rows[-2:]]
    assert sizes[1] == sorted(once, key=str)
    once.remove((None, near))
    assert sizes[2] == sorted(once, key=str)
    repeat = text("e", 200)
    assert [i for i, _ in sizes[3]] == [i for i, _ in sizes[2]] and dict(sizes[3])[5] in (good, text("b"))
    assert all(repeat not in t for _, t in sizes[3]) and dict(sizes[3])[11].startswith(text("d")) and dict(sizes[3])[12].endswith(text("f"))
    packed = corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in packed) == 5


def test_stages_on_a_table_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
