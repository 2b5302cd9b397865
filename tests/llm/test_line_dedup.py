import random

from reckon.llm import line_dedup


def corpus(rng):
    words = [f"w{k}" for k in range(300)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared = [[line(rng.choice([3, 8, 20, 30, 60])) for _ in range(rng.randint(1, 9))] for _ in range(8)]
    docs = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [line(rng.choice([1, 5, 30, 70])) for _ in range(rng.randint(1, 4))]
            if rng.random() < 0.2:
                parts.append(" ")
        docs.append((i, "\n".join(parts) + rng.choice(["", "\n"])))
    return docs + [(200, docs[3][1].upper()), (201, None), (202, ""), (203, (line(10) + "\n") * 40), (None, docs[5][1]), (7, docs[7][1])]


def test_texts_lose_their_later_copies(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    df = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd\n"), (3, "short\nlines")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(df).collect()}
    assert got == {1: f"a\n{passage}\nb", 2: "c\nd\n", 3: "short\nlines"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.repeated_spans(df).count() == 0 and line_dedup.drop_repeated_runs(df).count() == 0


def brute_words(docs, run=50):
    """Words inside any run of ``run`` words that stands at an earlier place, whatever its lines."""
    rows = sorted({(i is None, i if i is not None else 0, key, t or "") for i, key, t in docs})
    seen, out = set(), {}
    for no_id, i, _, text in rows:
        words, gone = text.lower().split(), set()
        for a in range(len(words) - run + 1):
            content = tuple(words[a : a + run])
            if content in seen:
                gone.update(range(a, a + run))
            seen.add(content)
        out[(None if no_id else i, text)] = gone
    return out


def words_gone(spark, docs):
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    rows = line_dedup.repeated_spans(df).collect()
    return rows, {r.doc_id: {k for a, b in r.spans for k in range(a, b + 1)} for r in rows}


def test_words_match_brute_force(spark):
    rng = random.Random(3)
    docs = corpus(rng)
    passage = [f"q{k}" for k in range(130)]
    for i in range(300, 320):  # passages cut anywhere, inside lines of other words
        a = rng.randint(0, 70)
        b = rng.randint(a + 45, 130)
        docs.append((i, f"left{i} more{i} " + " ".join(passage[a:b]) + f" right{i}\n" + docs[i % 80][1]))
    rows, gone = words_gone(spark, docs)
    keys = {r.doc_id: r.text_key for r in rows}
    want = brute_words([(i, keys[i], t) for i, t in docs])
    assert len(rows) == len(docs)
    for i, t in docs:
        assert gone[i] == want[(i, t or "")], i
    assert {r.doc_id: r.n_lines for r in rows} == {i: len((t or "").split("\n")) - ((t or "").endswith("\n") or not t) for i, t in docs}


def test_passages_inside_longer_lines_go(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    df = spark.createDataFrame([(1, f"one two {passage} three\nend"), (2, f"four {passage} five six\nmore"), (3, f"x\ny {passage}\nz")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(df).collect()}
    assert got == {1: f"one two {passage} three\nend", 2: "four five six\nmore", 3: "x\ny\nz"}


def test_a_run_goes_to_its_last_word(spark):
    line = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    docs = [(1, f"{line('a', 60)}\n{line('b', 40)}\n{line('x', 70)}"), (2, f"{line('c', 5)}\n{line('a', 60)}\n{line('b', 40)}\n{line('y', 70)}\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(df).collect()}
    assert got == {1: docs[0][1], 2: f"{line('c', 5)}\n{line('y', 70)}\n"}


def test_a_run_that_only_a_later_copy_shares(spark):
    """Three documents share a gram; only the second and third share the words around it. Extending every place to the
    first of its fingerprint would stop short and keep the third: windows are compared with all places."""
    gram = " ".join(f"g{i}" for i in range(30))
    around = lambda x: f"{' '.join(f'{x}{i}' for i in range(40))} {gram} {' '.join(f'{x}{i}' for i in range(40, 80))}"
    df = spark.createDataFrame([(1, around("a")), (2, around("b")), (3, around("b"))], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in line_dedup.repeated_spans(df).collect()}
    assert got == {1: [], 2: [], 3: [(0, 109)]}
