import random

import numpy as np

from marlstone.llm.substring_dedup import MAP_BITS, Sketcher, buckets, line_links, marked, op1_substring_dedup, repeated_keys, shingle_numbers, shingle_set, similar, slots, substring_dedup, tune_bands, units

SPAN = 49  # every shared run of 2 * WINDOW - 1 words has a window in common


def prose(r, n):
    return [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 400)}" for _ in range(n)]


def runs(texts):
    """Pairs of texts that share a run of at least SPAN words, by brute force."""
    grams = [{tuple(w[i : i + SPAN]) for i in range(len(w) - SPAN + 1)} for w in (t.lower().split() for t in texts)]
    return {(i, j) for i in range(len(texts)) for j in range(i) if grams[i] & grams[j]}


def groups(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_bands_meet_the_recall():
    bands, rows = tune_bands()
    assert bands * rows <= 64 and 1 - (1 - 0.8**rows) ** bands >= 0.995


def test_shared_passages_are_found_wherever_they_stand(docs):
    r = random.Random(5)
    passages = [prose(r, 55) for _ in range(6)]
    texts = []
    for i in range(40):
        words = prose(r, r.randint(60, 300))
        if i % 2:
            at = r.randint(0, len(words))
            words[at:at] = passages[i % 6]
        text = " ".join(words)
        texts.append(text.upper() if i % 5 == 0 else text.replace(" ", "\n", i % 4))
    out = {x.doc_id: x for x in substring_dedup(docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    want = groups(len(texts), runs(texts))
    assert [out[i].component_id for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        assert out[i].n_words == len(t.split())
        assert (out[i].removed_words > 0) == (want[i] != i)
        assert (out[i].n_links > 0) == (want.count(want[i]) > 1)


def test_near_lines_link_and_the_smallest_id_keeps(docs):
    r = random.Random(6)
    line = prose(r, 60)
    near = [*line[:30], "changed", *line[31:]]
    assert similar(shingle_set(" ".join(line)), shingle_set(" ".join(near)), 0.8)
    rows = [(i, "\n".join([" ".join(prose(r, 40)), " ".join(near if i % 2 else line), " ".join(prose(r, 40))]), "s") for i in range(10, 16)]
    out = {x.doc_id: x for x in substring_dedup(docs(rows)).collect()}
    assert {x.component_id for x in out.values()} == {10}
    assert out[10].removed_spans == "" and all("40:100" in x.removed_spans for i, x in out.items() if i != 10)


def test_blocks_of_a_large_bucket_lose_no_link(spark):
    r = random.Random(7)
    base = prose(r, 60)
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(60)] + [" ".join(prose(r, 60)) for _ in range(20)]
    classes = spark.createDataFrame([(i, t, [1, 2]) for i, t in enumerate(texts)], "node long, text string, keys array<long>")
    sets = [shingle_set(t) for t in texts]
    want = groups(len(texts), {(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j], 0.8)})
    for block in (7, 1000):
        found = {(max(x), min(x)) for x in line_links(classes, 0.8, 5, block).collect()}
        assert groups(len(texts), found) == want


def test_edges(docs, edge_rows):
    out = substring_dedup(docs([*edge_rows, (None, edge_rows[5][1], "c")])).collect()
    assert len(out) == len(edge_rows) + 1
    by = {x.doc_id: x for x in out}
    assert by[7].component_id == 6 and by[7].removed_words == 30_000 and by[6].removed_words == 0
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[None].n_links == 0
    assert all(x.component_id == x.doc_id for x in out if x.doc_id not in (7, None))
    assert substring_dedup(docs([])).count() == 0


def test_one_word_repeated(docs):
    s = Sketcher().sketch("la " * 5000)
    assert len(s.windows) == 200
    out = {x.doc_id: x for x in substring_dedup(docs([(1, "la " * 100, "s"), (2, "la " * 60, "s"), (3, "na " * 60, "s")])).collect()}
    assert out[2].component_id == 1 and out[3].n_links == 0


def test_query_sketches_short_and_wrapped_paragraphs(spark, docs, tmp_path):
    r = random.Random(8)
    short, five = " ".join(prose(r, 12)), " ".join(prose(r, 5))
    wrapped = prose(r, 60)
    near = [*wrapped[:20], "changed", *wrapped[21:]]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    own = lambda: wrap(prose(r, 40), 10)
    texts = [f"{own()}\n\n{x}\n\n{own()}" for x in (short, short, wrap(wrapped, 9), wrap(near, 7))] + [five, five, own(), "four words are few", "four words are few"]
    docs([(i, t, "s") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    out = {x.doc_id: x for x in op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert [out[i].component_id for i in range(9)] == [0, 0, 2, 2, 4, 4, 6, 7, 8]
    assert [out[i].removed_spans for i in range(9)] == ["", "40:52", "", "40:100", "", "0:5", "", "", ""]


def test_equal_buckets_are_compared_once(spark):
    """Eleven bands that hold the same lines are one bucket; a band with one line more is another."""
    rows = [(i, k) for i in (3, 5, 9) for k in range(11)] + [(i, k) for i in (3, 5, 9, 12) for k in (20, -21)] + [(3, 30), (5, 31)]
    got = {(x.key, x["count"]) for x in buckets(spark.createDataFrame(rows, "node long, key long")).collect()}
    assert got == {(0, 3), (-21, 4)}


def test_map_lets_few_other_keys_through(spark):
    """All keys of the map pass; of others far less than the share of its bits that are set."""
    keys = np.random.default_rng(3).integers(0, 2**64, 3_000_000, dtype=np.uint64)
    held, others = keys[:2_000_000], keys[2_000_000:]
    shared = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    for slot in slots(held, 2):
        np.bitwise_or.at(shared, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
    assert marked(shared, held, 2).all() and marked(shared, others, 2).mean() < 0.002
    assert marked(shared, others, 1).mean() > 0.01


def test_map_of_repeated_keys(docs):
    """What Spark sets is what is looked up: keys of two rows pass, keys of one don't."""
    r = random.Random(9)
    lines = [" ".join(prose(r, 30)) for _ in range(40)]
    sketcher = Sketcher()
    shared, probes = repeated_keys(docs([(i, lines[i // 2] if i < 20 else lines[i], "s") for i in range(40)]), "text", sketcher)
    keys = [np.concatenate([x.window_keys, x.line_keys.ravel()]) for x in map(sketcher.sketch, lines)]
    assert probes == 2 and all(marked(shared, k, probes).all() for k in keys[:10]) and not any(marked(shared, k, probes).any() for k in keys[20:])


def test_texts_are_sketched_once(docs, tmp_path):
    """Both passes read one table of sketches: each text goes through the sketcher once."""
    calls = f"{tmp_path}/calls"

    class Own(Sketcher):
        def sketch(self, text):
            with open(calls, "ab", buffering=0) as f:
                f.write(b".")
            return Sketcher.sketch(self, text)

    r = random.Random(10)
    lines = [" ".join(prose(r, 60)) for _ in range(20)]
    table = units(docs([(i, lines[i // 2], "s") for i in range(40)]), "doc_id", "text", Own())
    assert {(x.kind, x.id) for x in table.collect()} >= {(k, i) for k in (0, 1, 2) for i in range(40)}
    assert len((tmp_path / "calls").read_bytes()) == 40


def test_shingles_of_nested_paragraphs_are_hashed_once():
    """A block's keys come from its lines' parts; they equal those of each paragraph alone."""
    r = random.Random(11)
    lines = [" ".join(prose(r, n)) for n in (7, 30, 4, 5, 50, 6000, 3, 9)]
    text = "\n".join(lines[:3]) + "\n\n" + "\n".join(lines[3:])
    hashed = []

    class Own(Sketcher):
        def hashes(self, grams):
            hashed.append(len(grams))
            return super().hashes(grams)

    s = Own(least=5).sketch(text)
    assert sum(hashed) <= len(s.words) and len(s.lines) == 8
    for (start, n), keys in zip(s.lines, s.line_keys, strict=True):
        alone = Sketcher(least=5).sketch(b" ".join(s.words[start : start + n]).decode())
        assert alone.lines == [(0, n)] and (alone.line_keys[0] == keys).all()


def test_numbers_stand_for_shingles():
    """Sizes and common shingles are those of the sets of words, for texts short and long, with repeats and of other white space."""
    r = random.Random(12)
    texts = ["", "a b c d", "a b c d e", "a a a a a a a", "a b c d\xa0e f g", *(" ".join(r.choices("abc", k=r.randint(1, 60))) for _ in range(30))]
    for shingle in (1, 2, 5):
        sets, numbers = [shingle_set(t, shingle) for t in texts], shingle_numbers(texts, shingle)
        assert [len(x) for x in numbers] == [len(x) for x in sets]
        assert all(len(numbers[i] & numbers[j]) == len(sets[i] & sets[j]) for i in range(len(texts)) for j in range(i))
