import hashlib

from corpusloom.operators import versioning


def test_fingerprint_digests_sorted_hashes(spark):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    hashes = sorted(md5(str(k))[:16] for k in range(2000))
    rows = [(h, "active") for h in hashes[::-1] + hashes[:9]] + [("ff", "pending")]
    chunks = spark.createDataFrame(rows, "hash string, status string")
    parts: dict[str, list[str]] = {}
    for h in hashes:
        parts.setdefault(h[:2], []).append(h)
    want = md5("|".join(md5("|".join(parts[b])) for b in sorted(parts)))
    assert versioning.fingerprint(chunks).collect()[0][0] == want
    assert versioning.fingerprint(chunks.filter("status = 'x'")).collect()[0][0] is None
