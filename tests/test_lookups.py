import random

from pyspark.sql import functions as F

from tamiz.operators import domains


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def test_verdicts_against_all_pairs(spark):
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choices("ab.c", k=n))

    listed = sorted({word(rng.randint(1, 9)) for _ in range(60)} | {"example.com", "bank.example.org"})
    seen = {word(rng.randint(1, 10)) for _ in range(400)} | {
        "mail.example.com", "example.com", "examp1e.com", "exmple.com", "com", "xbank.example.org", "notexample.com"}
    seen = sorted(seen)
    df = spark.createDataFrame([(d,) for d in seen * 2], "from_domain string")
    allow = spark.createDataFrame([(d,) for d in listed], "domain string")
    got = {r["from_domain"]: r for r in domains.sender_verdicts(df, allow).collect()}
    for d in seen:
        parts = d.split(".")
        parents = [".".join(parts[i:]) for i in range(1, len(parts) - 1)]
        expected_listed = d in listed or any(p in listed for p in parents)
        close = sorted((distance(d, w), w) for w in listed if w != d and distance(d, w) <= 2)
        row = got.get(d)
        assert bool(row and row["whitelisted"]) == expected_listed, d
        assert (row["homograph_of"] if row else None) == (close[0][1] if close else None), d


def test_empty_list_and_missing_domain(spark):
    df = spark.createDataFrame([("r1", "a.example"), ("r2", "")], "report_id string, from_domain string")
    allow = spark.createDataFrame([], "domain string")
    rows = domains.attach_sender_verdicts(df, allow).collect()
    assert [(r["whitelisted"], r["homograph"]) for r in rows] == [(False, None)] * 2


def test_reputation(spark):
    df = spark.createDataFrame([("r1", "192.0.2.1"), ("r2", "192.0.2.9"), ("r3", "")],
                               "report_id string, sender_ip string")
    known = spark.createDataFrame([("192.0.2.1", 55, "AR", "isp"), ("192.0.2.1", 55, "AR", "isp"), ("", 99, "", "")],
                                  "ip string, abuse_score int, country string, isp string")
    got = {r["report_id"]: r["ip_reputation"] for r in domains.ip_reputation_join(df, known).collect()}
    assert len(got) == 3
    assert (got["r1"]["abuse_score"], got["r1"]["checked"]) == (55, True)
    assert (got["r2"]["abuse_score"], got["r2"]["checked"]) == (-1, False)
    assert (got["r3"]["abuse_score"], got["r3"]["checked"]) == (-1, False)
    none = domains.ip_reputation_join(df, None).select(F.col("ip_reputation.abuse_score").alias("s")).collect()
    assert {r["s"] for r in none} == {-1}


def test_long_names_against_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh-", k=n)) + ".example.com" for n in (17, 18, 19, 20, 21, 30, 60, 200)]
    seen = set(base)
    for b in base:
        for _ in range(40):
            s = list(b)
            for _ in range(rng.randint(1, 3)):
                at, what = rng.randrange(len(s)), rng.randrange(3)
                s[at:at + (what != 0)] = [] if what == 1 else [rng.choice("abx.")]
            seen.add("".join(s))
    seen = sorted(seen | {"deep." * 30 + b for b in base[:3]})
    df = spark.createDataFrame([(d,) for d in seen], "from_domain string")
    allow = spark.createDataFrame([(d,) for d in base], "domain string")
    got = {r["from_domain"]: r for r in domains.sender_verdicts(df, allow).collect()}
    for d in seen:
        parts = d.split(".")
        listed = d in base or any(".".join(parts[i:]) in base for i in range(1, len(parts) - 1))
        close = sorted((distance(d, w), w) for w in base if w != d and abs(len(w) - len(d)) <= 2 and distance(d, w) <= 2)
        row = got.get(d)
        assert bool(row and row["whitelisted"]) == listed, d
        assert (row["homograph_of"] if row else None) == (close[0][1] if close else None), d


def test_one_crafted_name_costs_little(spark):
    names = ["x" * 100_000, "a." * 50_000 + "example.com", "y" * 50_000 + ".example.com", "example.com"]
    df = spark.createDataFrame([(d,) for d in names], "from_domain string")
    allow = spark.createDataFrame([("example.com",), ("z" * 300 + ".example",)], "domain string")
    keys = df.select(F.size(domains._domain_keys(308)).alias("n")).collect()
    assert max(r["n"] for r in keys) < 800
    got = {r["from_domain"]: r["whitelisted"] for r in domains.sender_verdicts(df, allow).collect()}
    assert got == {names[1]: True, names[2]: True, names[3]: True}
