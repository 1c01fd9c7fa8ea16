"""Quality rules, secret scans, license scans and sharding against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from granary.llm import licenses, quality, secrets, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long, host string, spans int"


def docs(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, None, source(i), None, "x", 1) for i, t in enumerate(texts)], DOC)


def random_texts(seed=3, n=80):
    rng = random.Random(seed)
    lines = ["Share this  page now please", "all rights\treserved é", " ", "", "x#y * z"]
    out = []
    for _ in range(n):
        body = [" ".join(rng.choice(["alpha", "Beta", "gamma", "dé", "e<", "f$g"]) + str(rng.randrange(30)) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(0, 6))]
        body += rng.choices(lines, k=rng.randint(0, 4)) + rng.choices(body or [""], k=rng.randint(0, 3))
        rng.shuffle(body)
        out.append("\n".join(body))
    return out + [None, "", "\n\n", " ", "a", "\n".join(["one two three four five six seven eight nine"] * 4)] + out[:5]


def plain_quality(rows):
    """rows: (id, text, host)"""
    out, lines, seen, hosts = {}, defaultdict(set), {}, defaultdict(set)
    for i, t, h in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        real = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out[i] = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(real) - len(set(real)), len(hit)]
        own = Counter()
        for x in real:
            own[" ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).lower()] += len(re.findall(r"[^\x20\x09-\x0D]+", x))
        seen[i] = own
        hosts[h].add(t)
        for x in own:
            lines[h, x].add(t)
    for i, t, h in rows:
        gone = sum(n for x, n in seen[i].items() if len(lines[h, x]) > quality.LINE_DOCS and len(lines[h, x]) > quality.LINE_SHARE * len(hosts[h]))
        n, rep = out[i][0], out[i][4]
        failed = n < 20 or 100 * rep > 30 * n
        out[i] += [gone, failed, not failed and gone <= quality.DEPLETED * n]
    return {(i, *v) for i, v in out.items()}


def test_quality_like_plain_python(spark):
    texts = random_texts()
    host = lambda i: [None, "a", "b"][i % 3]
    got = {tuple(r) for r in quality.score(docs(spark, texts, host)).collect()}
    assert got == plain_quality([(i, t, host(i)) for i, t in enumerate(texts)])
    df = docs(spark, texts, host)
    good = quality.keep_good(df)
    assert good.columns == df.columns and {r.doc_id for r in good.collect()} == {r[0] for r in got if r[-1]}
    assert quality.score(docs(spark, [])).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(docs(spark, ['lorem ipsum token = "%s" dolor sit amet' % hashlib.sha1(bytes([i])).hexdigest() for i in range(50)] + ["plain words from 2020-01-01 in example-file-name-12345 only"] * 50))


def test_base_spans_and_flags(spark, model):
    rng = random.Random(8)
    bits = ["token", "SECRET", "apikey", "api_Key", '"', "'", ":", "=", " ", "  ", "AKIA", "ABCDEFGHIJKL0", "deadbeef" * 4, "abcdefg", "12345678", "é", "\n", "passwd", "Password", "ſecret", "x.y/z+9", "secret=token:abcdefgh12"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)] + [None, "", "a" * 40, "f" * 31, "0" * 32, "AKIA" + "A" * 11, "AKIA" + "A" * 12]
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs(spark, texts), model)).collect()}
    for i, t in enumerate(texts):
        spans = secrets.base_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        whole = secrets.scan_texts([t or ""], model)[0]
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, b, k in whole)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for *_, k in spans) for x in ("assign", "access", "hex"))


def plain_base(text):
    """Base spans by walking the text, without regular expressions."""
    key, hexa = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), set("0123456789abcdef")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out, n = [], len(text)

    def run(i, allowed):
        j = i
        while j < n and text[j] in allowed:
            j += 1
        return j

    def assign(i):
        # longer alternatives do not matter: each name is tried in order, as the pattern lists them
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not lower.startswith(name, i):
                continue
            j = i + len(name)
            j += j < n and text[j] in "\"'"
            while j < n and text[j] == " ":
                j += 1
            if j < n and text[j] in ":=":
                j += 1
                while j < n and text[j] == " ":
                    j += 1
                j += j < n and text[j] in "\"'"
                end = run(j, key)
                if end > j:
                    return j, end
        return None

    i = 0
    while i < n:
        if found := assign(i):
            if found[1] - found[0] >= 8:
                out.append((i, 0, found[1], "assign"))
            i = found[1]
        else:
            i += 1
    i = 0
    upper = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    while i < n:
        if text.startswith("AKIA", i) and (end := run(i + 4, upper)) > i + 4:
            if end - i >= 16:
                out.append((i, 1, end, "access"))
            i = end
        else:
            i += 1
    i = 0
    while i < n:
        end = run(i, hexa)
        if end - i >= 32:
            out.append((i, 2, end, "hex"))
        i = max(end, i + 1)
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_like_a_plain_walk(spark, model):
    rng = random.Random(18)
    bits = ["token", "SECRET", "apikey", "api_Key", '"', "'", ":", "=", " ", "AKIA", "ABCDEFGHIJKL0", "deadbeef" * 4, "abcdefg", "12345678", "é", "\n", "passwd", "Password", "x.y/z+9", "secret=token:abcdefgh12", "secret=passwd"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(500)] + ["", "token=" + "k" * 100_000, "token=abcdefgh token=abcdefgh"]
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs(spark, texts + [None] + texts[:3]), model)).collect()}
    for i, t in enumerate(texts + [""] + texts[:3]):
        want = plain_base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for *_, k in want) for x in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(got[i].spans.split(","))  | ({""} if not want else set())
    assert secrets.digest(secrets.find_secrets(docs(spark, []), model)).count() == 0


def test_network_finds_held_out_keys_and_leaves_prose(model):
    windows, labels = secrets.drawn_findings(300, ["river", "stone", "cloud"], seed=99)
    p = model.probability(secrets.encode(windows))
    positive = [x for x, y in zip(p, labels) if y]
    negative = [x for x, y in zip(p, labels) if not y]
    assert sum(x >= model.threshold for x in positive) >= 0.93 * len(positive)
    assert sum(x >= model.threshold for x in negative) <= 0.03 * len(negative)


def test_every_candidate_is_scored(spark, model):
    """Each span's score is the largest of the network's on plain slices around the key; base spans stay below the threshold too."""
    long = "/".join(["path", "to", "file"] * 30) + "/x1"
    keys = ["Zk8Qw2Lp9Xv4Tn7Rb3Mc6Yd1", "aaaaaaaa", "deadbeef" * 6, "AKIA" + "B7" * 8, long]
    texts = [f"é before it token: {k} and what follows is plain prose, more of it" for k in keys] + [f"see {k} here" for k in keys] + [keys[0], "", None]
    rows = {r.doc_id: r for r in secrets.find_secrets(docs(spark, texts), model).collect()}
    seen = 0
    for i, t in enumerate(texts):
        base = [(s.start, s.end, s.kind) for s in rows[i].spans if s.kind != "model"]
        assert base == plain_base(t or "")
        for s in rows[i].spans:
            a = s.start + len("token: ") if s.kind == "assign" else s.start
            padded = " " * 24 + t + " " * 24
            whole = padded[a : s.end + 48]
            slices = [whole[k : k + 64].ljust(64) for k in range(0, max(1, len(whole) - 31), 32)]
            slices = [w for k, w in zip(range(0, max(1, len(whole) - 31), 32), slices) if k + 64 <= len(whole) or not k] + [whole[-64:].ljust(64)]
            want = max(model.probability(secrets.encode([w]))[0] for w in slices)
            assert abs(s.score - want) < 1e-9 and (s.kind != "model" or s.score >= model.threshold)
            seen += 1
    assert seen >= 8
    out = secrets.digest(secrets.find_secrets(docs(spark, texts), model)).collect()
    assert all(len(r.scores.split(",")) == len(r.spans.split(",")) for r in out)


def test_redaction(spark, model):
    df = docs(spark, ["a token=abcdefgh1 b password: hunter2hunter é", None, "", "clean text"])
    out = secrets.redact_secrets(df, model)
    assert out.columns == df.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["a [SECRET] b [SECRET] é", None, "", "clean text"]


def plain_licenses(text):
    def split(t):
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))

    def sh(w):
        return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []

    words, out = sh(split(text or "")), set()
    for name, t in licenses.TEMPLATES.items():
        own = set(sh(split(t)))
        reach = max(1, 4 * len(own) // 3)
        if any(len(own & set(words[a : a + reach])) >= 0.75 * len(own) for a in range(len(words))):
            out.add(name)
    return out


def test_licenses_like_plain_python(spark):
    rng = random.Random(4)
    texts = [None, "", "Released under the"]
    for _ in range(120):
        filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "the", "license", "under"]) for _ in range(rng.randint(0, 60)))
        name = rng.choice(list(licenses.TEMPLATES))
        w = licenses.TEMPLATES[name].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "changed"
        texts.append(filler() + "\n" + rng.choice([" ".join(w).upper(), " * ".join(w), " ".join(w)]) + " " + filler())
    got = {r.doc_id: {x.license for x in r.licenses} for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    want = {i: plain_licenses(t) for i, t in enumerate(texts)}
    assert got == want
    r = licenses.scan_licenses(docs(spark, ["é Released under the MIT License. z"])).first().licenses[0]
    assert (r.license, r.start, r.end) == ("mit-notice", 2, 32)


def test_lookup_table():
    names = [f"n{k}" for k in range(7)]
    table = sharding.lookup_table(names, 101)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == 101
    fewer = sharding.lookup_table(names[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 40
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_place(spark, tmp_path):
    df = spark.createDataFrame([(None, 1, 2), (1, 1, 2), (1, 3, 4), (2**40, 5, 6)], "doc_id long, shard int, slot string")
    table = sharding.lookup_table([f"shard-{k:05d}" for k in range(sharding.SHARDS)])
    for r in sharding.place(df).collect():
        slot = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:8], 16) % sharding.SIZE
        assert (r.slot, r.shard) == (slot, table[slot])
    sharding.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_candidates_are_scored_whole(model):
    key = "ghp_Zk3v9QxT7bLw2RmY8nPcD4sHfJ6gUaE1iKo0"
    path = "archive/river/stone/cloud/river/stone/cloud/river/stone"
    found = lambda t: [s for s in secrets.scan_texts([t], model)[0] if s[2] == "model"]
    for run in (f"{path}/{key}", f"{path}/{key}/{path}", f"{path}/{path}/{path}/{key}"):
        assert found(f"see {run} there") == [(4, 4 + len(run), "model")]
    assert not found(f"see {path}/{path}/{path}/12 there")
    # every character of a candidate and of the context on both sides is read
    for n in (16, 17, 40, 41, 64, 100, 1000):
        text = "b" * 24 + "k" * n + "a" * 24
        whole = secrets.passage("x" + text + "y", 25, 25 + n)
        assert whole == text
        read = {a + j for a, w in zip(secrets.starts(len(whole)), secrets.windows_of(whole)) for j in range(len(w)) if w == whole[a : a + secrets.WIDTH]}
        assert read == set(range(len(whole)))


def test_every_document_teaches_the_network(spark):
    """No document, finding or word is left out of the training, and how the rows are dealt changes nothing."""
    key = lambda i: hashlib.sha1(b"%d" % i).hexdigest()
    texts = [None, *(f"see file-{i:06d}.txt and file-{i:06d}.txt only token = {key(i)} words without" for i in range(3500))]
    df = docs(spark, texts)
    rows = secrets.labelled_passages(df.repartition(3)).collect()
    assert len(rows) == 7000 and sum(r.label for r in rows) == 3500
    assert {r.passage[24:64] for r in rows if r.label} == {key(i) for i in range(3500)}
    few = df.where("doc_id < 40")
    one, other = secrets.train(few.coalesce(1)), secrets.train(few.repartition(5))
    assert one.threshold == other.threshold and all((one.p[k] == other.p[k]).all() for k in one.p)


def test_threshold_follows_recall_alone():
    model = secrets.Network()
    model.logits = lambda x: x[:, 0].astype(float)
    score = [-3, -2, -1, *[1] * 97, *[-4] * 100]
    y = [1] * 100 + [0] * 100
    model.calibrate(secrets.np.array([[s, 0] for s in score]), secrets.np.array(y, float), secrets.np.arange(200))
    p = model.probability(secrets.np.array([[s, 0] for s in score]))
    assert sum(p[:100] >= model.threshold) == 98 and model.threshold < 0.9


def test_kept_texts_lose_their_frequent_lines(spark):
    body = [f"first {i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)]
    texts = [f"{b}\n\nShare  this PAGE\nlast é {i}" if i % 2 else f"share this page\n{b}\n \nshare\tthis page" for i, b in enumerate(body)]
    texts += [f"share this page\n{body[0]} other host", None, f"{body[1]}\nonly here"]
    host = lambda i: "b" if i == 40 else None if i > 40 else "a"
    df = docs(spark, texts, host)
    got = {r.doc_id: r for r in quality.keep_good(df.unionByName(df.where("doc_id = 3"))).collect()}
    rows = {r.doc_id: r for r in df.collect()}
    norm = lambda x: " ".join(x.split()).lower()
    for i, t in enumerate(texts[:40]):
        assert got[i].text == "\n".join(x for x in t.split("\n") if norm(x) != "share this page")
        assert got[i].asDict() | {"text": t} == rows[i].asDict()
        gone = len(t.split()) - len(got[i].text.split())
        assert gone == (3 if i % 2 else 6)
    assert got[40] == rows[40] and got[42] == rows[42] and 41 not in got


def test_common_wordings_and_full_texts(spark):
    lines = {
        "mit": ["Licensed under the MIT License", "under the terms of the MIT license", "This code is distributed under a MIT license."],
        "lgpl": ["It is released under the GNU Lesser General Public License.", "published under the terms of the GNU LGPL license"],
        "gpl-2.0": ["This is under the GNU General Public License version 2.", "licensed under GPL version 2"],
        "agpl-3.0": ["available under the GNU Affero General Public License v3"],
        "epl-2.0": ["made available under the terms of the Eclipse Public License 2.0"],
        "cc-by-sa-4.0": ["Text is shared under CC BY-SA 4.0 by all"],
        "zlib": ["distributed under the zlib license"],
    }
    texts = [(k, f"lorem é {t}\nipsum") for k, ts in lines.items() for t in ts]
    full = {k: t for k, t in licenses.all_templates().items() if k not in licenses.TEMPLATES}
    assert {"apache-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "mpl-2.0-text"} <= {k.replace("gpl-3-", "gpl-3.0-") for k in full}
    texts += [(k, "before " * 50 + t + " after" * 50) for k, t in full.items()]
    got = {r.doc_id: {x.license for x in r.licenses} for r in licenses.scan_licenses(docs(spark, [t for _, t in texts])).collect()}
    for i, (k, t) in enumerate(texts):
        assert k in got[i] or any(x.startswith((f"{k}-notice", f"{k}-header")) for x in got[i]), (k, t[:60], got[i])
    assert not any(x.startswith("gpl-3.0") for x in got[5] | got[6])
    assert [r.licenses for r in licenses.scan_licenses(docs(spark, ["the license of the general public under the law is free software", None])).collect()] == [[], []]
