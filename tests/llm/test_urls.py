"""URL filters against plain Python: templates, merged branches, purity and verdicts."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from vexil.llm.urls import RULES, judge_urls

CHILDREN, SPREAD, STRENGTH, REJECT = 12, 0.2, 5.0, 0.6


def parsed(url):
    if not url or "://" not in url:
        return "", ""
    rest = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return rest[1].lower(), rest[2]


def ruled(host, path):
    fit = [r for r in RULES if (host == (at := r[1].split("/", 1)[0]) or host.endswith("." + at)) and path.startswith("/" + r[1].split("/", 1)[1])]
    return max(fit, key=lambda r: len(r[1]), default=(None, None))


def shape(s):
    s = s.lower()
    return "<hex>" if re.fullmatch("[0-9a-f-]{16,}", s) else re.sub("[0-9]+", "<num>", s)


def templates(paths):
    out, now, level = {}, {k: "" for k in paths}, 0
    shapes = {k: [shape(s) for s in k[1].split("/") if s] for k in paths}
    while now:
        nodes = defaultdict(Counter)
        for k, prefix in now.items():
            if len(shapes[k]) > level:
                nodes[k[0], prefix][shapes[k][level]] += 1
        later = {}
        for k, prefix in now.items():
            if len(shapes[k]) <= level:
                out[k] = prefix
                continue
            node = nodes[k[0], prefix]
            total = sum(node.values())
            varies = len(node) >= CHILDREN and len(node) >= SPREAD * total
            rest = shapes[k][level:] if total == 1 else ["*" if varies else shapes[k][level]]
            new = "/".join([prefix, *rest] if prefix else rest)
            if total == 1:
                out[k] = new
            else:
                later[k] = new
        now, level = later, level + 1
    return out


def above(node):
    return None if not node else re.sub("/?[^/]*$", "", node)


def groups(units):
    """Per (host, parent): the groups of labelled units and all units."""
    family = defaultdict(list)
    for key, (up, bad, seen, n) in units.items():
        family[key[0], up].append((key, bad, seen))
    out = {}
    for at, members in family.items():
        parts, last = [], None
        for key, bad, seen in sorted((m for m in members if m[2]), key=lambda m: (m[1] / m[2], m[2], m[1])):
            if last is not None:
                p = (bad + last[0]) / (seen + last[1])
                if abs(bad / seen - last[0] / last[1]) > 1.96 * math.sqrt(p * (1 - p) * (1 / seen + 1 / last[1])):
                    parts.append([])
            if not parts:
                parts.append([])
            parts[-1].append((key, bad, seen))
            last = bad, seen
        out[at] = parts, members
    return out


def by_hand(urls):
    pages = [parsed(u) for u in urls]
    count = Counter(pages)
    template = templates(count)
    tally = defaultdict(lambda: [0, 0, 0])
    for k, n in count.items():
        verdict = ruled(*k)[0]
        t = tally[k[0], template[k]]
        t[0] += n * (verdict == "block")
        t[1] += n * (verdict is not None)
        t[2] += n
    units = {k: (above(k[1]), *v) for k, v in tally.items()}
    place = {k: k for k in units}
    while True:
        found = groups(units)
        merged = {m[0]: at for at, (parts, members) in found.items() if at[1] is not None and len(members) > 1 and len(parts) <= 1 for m in members}
        if not merged:
            break
        new = {}
        for key, (up, bad, seen, n) in units.items():
            to, top = ((key[0], f"{up}/**"), above(up)) if key in merged else (key, up)
            old = new.get(to, (top, 0, 0, 0))
            new[to] = (top, old[1] + bad, old[2] + seen, old[3] + n)
        place = {k: ((v[0], f"{units[v][0]}/**") if v in merged else v) for k, v in place.items()}
        units = new
    share = sum(t[0] for t in tally.values()) / max(1, sum(t[1] for t in tally.values()))
    over = defaultdict(lambda: [0, 0])
    for (_, node), (_, bad, seen, _) in units.items():
        over[node][0] += bad
        over[node][1] += seen
    purity = {}
    for parts, members in found.values():
        pooled = {m[0]: (sum(x[1] for x in part), sum(x[2] for x in part)) for part in parts for m in part}
        whole = sum(m[1] for m in members), sum(m[2] for m in members)
        for key, bad, seen in members:
            g_bad, g_seen = pooled.get(key, whole)
            prior = (over[key[1]][0] - bad + STRENGTH * share) / (over[key[1]][1] - seen + STRENGTH)
            purity[key] = (g_bad + STRENGTH * prior) / (g_seen + STRENGTH)
    out = []
    for k in pages:
        verdict, rule = ruled(*k)
        branch = place[k[0], template[k]]
        out.append((*k, rule, verdict or ("block" if purity[branch] >= REJECT else "allow"), template[k], branch[1], round(purity[branch], 9)))
    return out


def test_judgements_against_plain_python(spark):
    rng = random.Random(4)
    hosts = ["a.com", "b.com", "x.example.org", "EXAMPLE.org", "n.net", "de.com"]
    words = ["de", "fr", "es", "en", "blog", "tag", "p"]
    urls = [None, "", "no scheme/x", "http://", "https://A.com", "http://a.com/?q#f", "http://a.com//x///", "http://n.net/" + "/".join(f"s{i}x" for i in range(40))]
    urls += ["http://n.net/" + "t/" * i for i in range(9)] * 2  # deeper at every step
    for _ in range(500):
        parts = [rng.choice(words) for _ in range(rng.randrange(4))] + [rng.choice((str(rng.randrange(50)), "slug-" + "".join(rng.choices("abcdefgh", k=4)), f"{rng.getrandbits(70):020x}"))]
        urls.append(f"http://{rng.choice(hosts)}/{'/'.join(parts)}?x=1")
    for _ in range(120):  # a node of many children, and paths below the wildcard
        urls.append(f"http://user.com/{rng.choice(('de', 'fr'))}/u/{''.join(rng.choices('abcdef', k=5))}/{rng.choice(('posts', 'likes'))}/{rng.choice('xyz')}")
    urls += [urls[20]] * 60  # one hot URL
    df = spark.createDataFrame([(i if i % 50 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, template string").repartition(3)
    rows = judge_urls(df, RULES).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, r.branch, round(r.purity, 9)) for r in rows), key=str)
    want = sorted(((i if i % 50 else None, *w) for i, w in enumerate(by_hand(urls))), key=str)
    assert got == want
    assert any(w[6].endswith("/**") for w in want) and len({w[4] for w in want}) == 2 and any(w[3] is None and w[4] == "block" for w in want)


@pytest.mark.parametrize("urls", [[], [None, None], ["http://n.net/a", "http://n.net/b"]])
def test_few_rows(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert [r.verdict for r in judge_urls(df, RULES).collect()] == ["allow"] * len(urls)
