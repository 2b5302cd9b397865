import random
import re
import string

from pyspark.sql import functions as F

from reckon.llm import secret_scan


def brute(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return [(secret_scan.KINDS[k], s, e) for s, k, e in sorted(out)]


def scan(spark, texts, primed=secret_scan.IDENTIFIERS.encode()):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    return {r.doc_id: [tuple(s) for s in r.found] for r in secret_scan.find_secrets(df, primed).collect()}


def test_base_spans_match_brute_force(spark):
    rng = random.Random(4)
    bits = ["password=", "PassWd : ", "token = \"", "secret:'", "API_KEY=", "apikey = ", "ſecret=", "toKen=", "AKIA", "é ", " the ", "deadbeef00", "0123456789abcdef", "abcdefghijkl", "A1B2C3D4E5F6G7", "\n", "=", "x" * 11, '"']
    texts = [None, "", "é" * 50 + "AKIA" + "Z" * 14] + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)]
    texts.append("word " * 40000 + "password=abcdefghijklmnop")
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "novel"] == brute(t)


def test_word_counts_match_brute_force(spark):
    rng = random.Random(3)
    bits = ["Word", "naïve", "a_b-c", "x9", "9abc", "ab", "y" * 33, "word", " ", "\n", ".", "=", "tok3n", "ÉTÉ"]
    texts = [None, ""] + ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(200)]
    texts += texts[5:25]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hashed = {r.text: r.h for r in df.where("text is not null").selectExpr("text", "xxhash64(text) AS h").collect()}
    want = {}
    for t in texts:
        for w in {m[0].lower() for m in re.finditer(r"(?<![A-Za-z\x80-\U0010ffff_-])[A-Za-z\x80-\U0010ffff_-]+", t or "") if 3 <= len(m[0].encode()) <= 32 and not (t[m.end() : m.end() + 1].isdigit() or t[: m.start()][-1:].isdigit())}:
            mask, n = want.get(w, (0, 0))
            want[w] = mask | 1 << (hashed[t] & 63), n + 1
    rows = df.where("text is not null").selectExpr("xxhash64(text) AS h", "text").mapInArrow(secret_scan._word_counts, "word string, spread long, n long").groupBy("word").agg(F.bit_or("spread").alias("s"), F.sum("n").alias("n")).collect()
    low = {r.word: (r.s & (1 << 64) - 1, r.n) for r in rows}
    # words that differ in the case of letters beyond A-Z are one word only when put together by Spark
    assert {k: v[0] for k, v in low.items()} == {k: v[0] for k, v in want.items()}


def test_planted_secrets_and_benign_strings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    primed = secret_scan.fit_dictionary(docs)
    novelty = secret_scan.Novelty(primed)
    texts = [r.text for r in docs.where("length(text) > 400").orderBy("doc_id").limit(200).collect()]
    rng = random.Random(11)
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    words = [w for w in secret_scan.IDENTIFIERS.split() if w.isalpha() and len(w) > 3]
    word = lambda: rng.choice(words)
    secrets = [lambda: some(alnum, 16), lambda: some(alnum, 40), lambda: some(hexes, 32), lambda: some(hexes, 40), lambda: some(alnum + "+/", 44), lambda: some(alnum + "+/", 2000), lambda: "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))]
    benign = [lambda: f"/{word()}/{word()}/{word()}/v2", lambda: f"http://{word().lower()}.example.com/{word()}", lambda: f"{word()}{word().title()}{word().title()}Id", lambda: f"{word()}_{word()}_{word()}_id2",
              lambda: f"{word()}-{word()}-2024.tar.gz", lambda: f"{word().upper()}_{word().upper()}_KEY2", lambda: f"2024-{rng.randint(10, 12)}-{rng.randint(10, 28)}T10", lambda: "application/x-www-form-urlencoded2", lambda: "deadbeef" * 4]

    def found(make):
        s, text = make(), rng.choice(texts)
        at = text.find(" ", rng.randrange(len(text) - 100))
        lead = text[:at] + " " + rng.choice(["bearer ", "the password is ", "credential ", "api_key: ", "token=", "secret is "])
        return any(x < len(lead) + len(s) and len(lead) < y for x, y in novelty.spans(lead + s + " " + text[at:]))

    assert sum(found(m) for m in secrets for _ in range(30)) >= 0.9 * 30 * len(secrets)
    assert sum(found(m) for m in benign for _ in range(30)) <= 0.1 * 30 * len(benign)


def test_every_kind_and_length_is_found():
    """Each kind at each length, up to the reach behind the word; not one rate over all."""
    rng = random.Random(31)
    novelty = secret_scan.Novelty(secret_scan.IDENTIFIERS.encode())
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    kinds = {"all": low + up + digits, "small": low + digits, "capitals": up + digits, "base32": up + "234567", "symbols": low + up + digits + "!@#$%", "hex": "0123456789abcdef", "letters": low + up, "base64": low + up + digits + "+/"}
    filler = "the quiet river runs under the old stone bridge and on to the sea and back again to the hills " * 2

    def rate(chars, n, gap):
        found = 0
        for _ in range(100):
            s = "".join(rng.choices(chars, k=n))
            lead = f"see the bearer {filler[:gap].strip()} "
            found += any(a <= len(lead) and len(lead) + n <= b for a, b in novelty.spans(f"{lead}{s} {filler}"))
        return found / 100

    for name, chars in kinds.items():
        for n in (16, 20, 24, 32, 48):
            assert rate(chars, n, 0) >= 0.9, (name, n)
    for gap in (40, 60, 90, 120):
        assert rate(kinds["all"], 24, gap) >= 0.9, gap
    assert rate(kinds["all"], 24, secret_scan.REACH + 2) == 0


def test_novel_strings_of_the_documents_lie_in_sensitive_places(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = secret_scan.find_secrets(docs, secret_scan.fit_dictionary(docs)).collect()
    planted = [(r.text, m.start(1)) for r in rows for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")]
    told = {(r.text, s.start) for r in rows for s in r.found if s.kind == "novel"}
    assert planted and len(set(planted) & told) >= 0.9 * len(set(planted))
    assert len(told - set(planted)) <= 0.1 * len(told)


def test_novel_strings_are_reported(spark):
    rng = random.Random(8)
    blob = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    words = [f"the session needs a bearer credential {blob} to go on", "the bearer of this credential application/json Content-Type client_secret access_token", f"nothing sensitive here {blob} at all"]
    got = scan(spark, words)
    assert [s[0] for s in got[0]] == ["novel"]
    assert words[0][got[0][0][1] : got[0][0][2]] == blob
    assert got[1] == [] and got[2] == []


def test_dictionary_is_repeatable(spark):
    df = spark.createDataFrame([(i, f"some text {i} " * 30) for i in range(80)], "doc_id long, text string")
    assert secret_scan.fit_dictionary(df) == secret_scan.fit_dictionary(df)
    assert secret_scan.find_secrets(df.limit(0), secret_scan.fit_dictionary(df.limit(0))).count() == 0


def test_repeated_secrets_do_not_hide_themselves(spark):
    rng = random.Random(9)
    blobs = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(40)]
    filler = "the quiet river runs under the old stone bridge and on to the sea " * 5
    texts = [f"bearer {b}\nbearer {b}\n" for b in blobs]
    texts += [f"auth_key_first={b}\nauth_key_other={b}\n" for b in blobs]
    texts += [f"bearer {b} {filler[: 190 + i]} bearer {b}" for i, b in enumerate(blobs)]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        b = blobs[i % 40]
        ends = [m.end() for m in re.finditer(b, t)]
        assert [(k, e) for k, _, e in got[i]] == [("novel", e) for e in ends], t
