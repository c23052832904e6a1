"""Secret scans: rules against plain regular expressions, models against a dictionary version, held-out strings."""

import hashlib
import math
import random
import re
import string

from bioloom.llm import secrets

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, spans int, `text_ of` string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 3, "y") for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], SCHEMA)


def plain_rules(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign", m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end(), "access", m.group()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end(), "hex", m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans).encode()).hexdigest()


def plain_model(texts):
    """Log ratios of every character after two, by dictionaries of counts."""
    strings = {(s, False) for t in texts for s in plain_strings(t)} | {(s[4], True) for t in texts for s in plain_rules(t)}
    alphabet = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-."
    size = len(alphabet) + 1
    three, two, one = ({}, {}, {}), ({}, {}, {}), ({}, {}, {})
    for s, label in strings:
        padded = "^^" + s
        for i in range(2, len(padded)):
            for counts, key in ((three, padded[i - 2 : i + 1]), (two, padded[i - 1 : i + 1]), (one, padded[i])):
                counts[label][key] = counts[label].get(key, 0) + 1

    def after(counts, prefix):
        return sum(n for key, n in counts.items() if key.startswith(prefix))

    def own(padded, key):
        return sum(padded[i - len(key) + 1 : i + 1] == key for i in range(2, len(padded)))

    def before(padded, key):
        return sum(padded[i - len(key) : i] == key for i in range(2, len(padded)))

    def probability(label, a, b, c, less):
        p = (one[label].get(c, 0) - own(less, c) + 4 / size) / (after(one[label], "") - max(len(less) - 2, 0) + 4)
        p = (two[label].get(b + c, 0) - own(less, b + c) + 4 * p) / (after(two[label], b) - before(less, b) + 4)
        return (three[label].get(a + b + c, 0) - own(less, a + b + c) + 4 * p) / (after(three[label], a + b) - before(less, a + b) + 4)

    def score(s):
        padded = "^^" + s
        total = 0.0
        for i in range(2, len(padded)):
            a, b, c = padded[i - 2 : i + 1]
            total += math.log(0.5 * probability(True, a, b, c, "") + 0.5 / size) - math.log(0.95 * probability(False, a, b, c, padded) + 0.05 / size)
        return total

    return score


def plain_strings(text):
    left = list(text or "")
    for a, _, b, _, _ in plain_rules(text):
        left[a:b] = " " * (b - a)
    return re.findall(r"[A-Za-z0-9+/_=-]{4,}", "".join(left))


def plain_scan(texts):
    score = plain_model(texts)
    for text in texts:
        spans = plain_rules(text)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text or ""):
            if len(m.group()) >= 16 and not any(a < m.end() and m.start() < b for a, _, b, _, _ in spans) and score(m.group()) >= 20:
                spans = [*spans, (m.start(), 3, m.end(), "model", m.group())]
        yield sorted(spans)


CASES = [
    None, "", "plain words only", 'é token = "abcdef" ü', "TOKEN:abcde", "api_key='x.y=z/+-_' apikey: zzzzzz", "token = token = secret1", "password=ſecret1 paſſwd=123456",
    "toKen=abcdef", "AKIA" + "Z" * 16, "AKIA" + "Z" * 15, "xAKIAAKIA" + "Q7" * 8 + "é", "f" * 23, "f" * 24, "g" + "0a" * 12 + "G" + "9" * 30, "token=" + "ab12" * 8, "secret: AKIA" + "A1" * 10 + " " + "0" * 24,
    "pass word=abcdef passwd  =  'abc", "zK8qPw3XvT1nR7bYe0LsHd", "öl zK8qPw3XvT1nR7bYe0LsHd,zK8qPw3XvT1nR7bYe0LsHd", "internationalization of organizations and administrations",
    'passwd"  :  "hunter22" api__key=abcdef', "tokentoken=abcdefg", "a\x00b token=abcdef\x00zzz",
]


def expected(texts):
    return [(*[sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")], digest([s for s in spans if s[1] < 3]), ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans)) for spans in plain_scan(texts)]


def test_against_plain_version(spark):
    texts = CASES + [f"identifier_{w}_of_{v} und {w}heit" for w in ("alpha", "beta", "gamma", "delta") for v in ("count", "index")]
    rows = {r["doc_id"]: tuple(r)[1:] for r in secrets.scan_documents(table(spark, texts).repartition(3)).collect()}
    assert [rows[i] for i in range(len(texts))] == expected(texts)
    assert any("model" in r[4] for r in rows.values())


def test_given_table_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: tuple(r)[1:] for r in secrets.scan_documents(docs).collect()}
    assert len(rows) == 1000
    for i, text in texts.items():
        spans = plain_rules(text)
        assert rows[i][:4] == (*[sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")], digest(spans))


def test_strings_left_out_of_training_are_judged_as_labelled(spark):
    found = secrets.held_out_accuracy(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert all(right >= 0.98 * n and n > 5 for n, right in found.values()) and set(found) == {"random", "ordinary"}


def test_random_strings_of_other_kinds_are_found_and_other_names_are_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    planted = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for n in (20, 24, 32, 40) for _ in range(25)]
    ordinary = ["get_user_account_settings", "organization-administration", "docs/reference/operations", "4929348385146306", "ANOTHERHEADEROFSOMETHING"]
    found = {r["string"]: r["score"] for r in secrets.string_scores(spark.createDataFrame([(s, True) for s in planted + ordinary], "string string, secret boolean"), secrets.learn(docs)).collect()}
    assert sum(found[s] >= secrets.LEAST_RATIO for s in planted) >= 97
    assert all(found[s] < secrets.LEAST_RATIO for s in ordinary)


def test_a_string_doesnt_vouch_for_itself(spark):
    rng = random.Random(4)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    planted = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for n in (20, 32) for _ in range(20)]
    rows = secrets.scan_documents(table(spark, texts + [f"the key is {s}, or so" for s in planted] * 2)).collect()
    found = {r["doc_id"]: r["spans"] for r in rows}
    right = sum(found[300 + i] == f"model:11:{11 + len(planted[i % 40])}" for i in range(80))
    assert right >= 76 and not any("model" in found[i] for i in range(300))


def test_empty_table_repeated_rows_null_ids_and_no_labels(spark):
    assert secrets.scan_documents(table(spark, [])).collect() == []
    rows = secrets.scan_documents(table(spark, ["token=abcdef", "token=abcdef", None], [None, None, 4])).collect()
    assert sorted((str(r["doc_id"]), r["n_assign"], r["spans"]) for r in rows) == [("4", 0, ""), ("None", 1, "assign:0:12"), ("None", 1, "assign:0:12")]
    # Without any random sample all characters are equally likely in one.
    assert [r["spans"] for r in secrets.scan_documents(table(spark, ["just a few words"])).collect()] == [""]


def test_other_columns_stay(spark):
    docs = table(spark, ["token=abcdef"])
    found = secrets.find_secrets(docs, secrets.learn(docs))
    assert found.columns == ["doc_id", "lang", "text_ of", "spans"] and found.collect()[0]["spans"][0]["kind"] == "assign"


def test_very_long_text(spark):
    text = "wörter und zahlen " * 150_000 + "token=abcdef " + "e" * 3_000_000
    row = secrets.scan_documents(table(spark, [text])).collect()[0]
    at = text.index("token")
    assert row["n_assign"] == 1 and row["n_hex"] == 1 and row["base_sha256"] == digest(plain_rules(text)) and row["spans"].startswith(f"assign:{at}:{at + 12}")
