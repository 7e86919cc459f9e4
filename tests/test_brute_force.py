"""The queries that SQL can't express, against plain Python loops."""

import difflib
import itertools
from collections import defaultdict

import pytest
import regex
from dealgrain.functions.text_ops import HEADING_STOP_WORDS, STOP_WORDS
from dealgrain.plans import catalogue


def norm(t):
    return regex.sub(r"[^\p{L}\p{N}_]+", " ", (t or "").lower()).strip(" ")


def words(t, stop=STOP_WORDS):
    return {w for w in norm(t).split(" ") if w and w not in stop}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(nodes, edges):
    root = {n: n for n in nodes}
    for a, b in edges:
        x, y = sorted((root[a], root[b]))
        root = {n: x if r == y else r for n, r in root.items()}
    return root


@pytest.fixture(scope="module")
def trails(spark, sf):
    """{document: [(version, text)]} of near copies, in order."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = {i: words(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sorted(held), 2) if held[a] and held[b] and jaccard(held[a], held[b]) >= 0.8]
    root = components(held, edges)
    out = defaultdict(list)
    for i, t in sorted(rows):
        if any(i in e for e in edges):
            out[root[i]].append((i, t))
    assert len(out) > 5
    return out


def lines(t):
    return [x for x in (y.strip(" ") for y in (t or "").split("\n")) if x]


def greedy(scored):
    """One to one, the best first, of [(similarity, i, j)]."""
    out, one, other = [], set(), set()
    for s, i, j in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
        if i not in one and j not in other:
            out.append((i, j, s))
            one.add(i)
            other.add(j)
    return out


def moved(trails):
    """{(document, round): [(i, j, basis, similarity)]}"""
    found = {}
    for doc, versions in trails.items():
        for r, ((_, a), (_, b)) in enumerate(itertools.pairwise(versions), 1):
            a, b = (list(enumerate(lines(t), 1)) for t in (a, b))
            at = defaultdict(lambda: ([], []))
            for side, rows in enumerate((a, b)):
                for k, t in rows:
                    if len(norm(t)) >= 30:
                        at[norm(t)][side].append(k)
            exact = [(i, j) for x, y in at.values() for i, j in zip(x, y)]
            one, other = {i for i, _ in exact}, {j for _, j in exact}
            scored = [(jaccard(words(t), words(u)), i, j) for i, t in a if i not in one and len(words(t)) >= 8 for j, u in b if j not in other and len(words(u)) >= 8]
            found[doc, r] = [(i, j, "content_exact", 1.0) for i, j in exact] + [(i, j, "content_jaccard", s) for i, j, s in greedy([x for x in scored if x[0] >= 0.8])]
    return found


def test_moves(spark, sf, trails):
    got = {(r.document_id, r.version_ord, r.i, r.j, r.basis, round(r.similarity, 9)) for r in catalogue.QUERIES["move_greedy_match"](spark, sf).collect()}
    assert got == {(d, r, i, j, b, round(s, 9)) for (d, r), rows in moved(trails).items() for i, j, b, s in rows} and got


def test_chains(spark, sf, trails):
    nodes = {(d, v, k) for d, versions in trails.items() for v, (_, t) in enumerate(versions, 1) for k in range(1, len(lines(t)) + 1)}
    matched = [((d, r, i), (d, r + 1, j), b, s) for (d, r), rows in moved(trails).items() for i, j, b, s in rows]
    root = components(nodes, [(a, b) for a, b, _, _ in matched])
    want = defaultdict(set)
    for n in nodes:
        want[root[n]].add(n)
    score = defaultdict(lambda: ([], []))
    for a, _, b, s in matched:
        score[root[a]][0].append(s)
        score[root[a]][1].append(b == "content_exact")
    got, seen = defaultdict(set), {}
    for r in catalogue.QUERIES["aligned_chains"](spark, sf).collect():
        n = (r.document_id, r.version_ord, r.ord)
        got[r.alignment].add(n)
        seen[n] = (round(r.confidence, 9), r.match_basis)
    assert set(map(frozenset, got.values())) == set(map(frozenset, want.values()))
    told = {n: (round(min(score[root[n]][0]), 9), "content_exact" if all(score[root[n]][1]) else "content_jaccard") if root[n] in score else (1.0, "none") for n in nodes}
    assert seen == told


def hunks(a, b):
    a, b = (regex.sub(r"\s+", " ", x or "").strip().split(" ") if x and x.strip() else [] for x in (a, b))
    return [(k, " ".join(a[i:j]), " ".join(b[x:y])) for k, i, j, x, y in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if k != "equal"]


def changed(trails):
    for doc, versions in trails.items():
        for r, ((_, a), (_, b)) in enumerate(itertools.pairwise(versions), 1):
            for k, (x, y) in enumerate(itertools.zip_longest(lines(a), lines(b)), 1):
                if x != y:
                    yield doc, k, r, x, y


def test_hunks(spark, sf, trails):
    got = {(r.document_id, r.alignment, r.round, r.hunk, r.kind, r.old_text, r.new_text) for r in catalogue.QUERIES["word_hunks"](spark, sf).collect()}
    assert got == {(d, k, r, n, *h) for d, k, r, x, y in changed(trails) if x is not None and y is not None for n, h in enumerate(hunks(x, y))} and got


def test_reversals(spark, sf, trails):
    got = {(r.document_id, r.alignment, r.round, r.kind, r.proposed_text, tuple(r.lost_words)) for r in catalogue.QUERIES["reversals"](spark, sf).collect()}
    want = set()
    for d, k, r, x, y in changed(trails):
        if y is None:
            continue
        text = y if x is None else " ".join(new for kind, _, new in hunks(x, y) if kind in ("insert", "replace") and new)
        last = lines(trails[d][-1][1])
        lost = words(text) - (words(last[k - 1]) if k <= len(last) else set())
        if words(text) and lost:
            want.add((d, k, r, "added" if x is None else "modified", text, tuple(sorted(lost))))
    assert got == want and want


def ratio(a, b):
    return difflib.SequenceMatcher(None, [x.strip() for x in (a or "").split("\n") if x.strip()], [x.strip() for x in (b or "").split("\n") if x.strip()]).ratio()


def test_distances(spark, sf, trails):
    got = {(r.document_id, r.version, r.other): round(r.distance, 9) for r in catalogue.QUERIES["pairwise_line_distance"](spark, sf).collect()}
    assert got == {(d, a, b): round(1 - ratio(t, u), 9) for d, vs in trails.items() for (a, t), (b, u) in itertools.combinations(vs, 2)}


def test_orders(spark, sf, trails):
    got = defaultdict(dict)
    for r in catalogue.QUERIES["chain_order"](spark, sf).collect():
        got[r.document_id][r.version_ord] = r
    assert got.keys() == trails.keys()
    for d, vs in trails.items():
        text = dict(vs)
        dist = {frozenset(p): 1 - ratio(text[min(p)], text[max(p)]) for p in itertools.combinations(text, 2)}
        cost = lambda c: sum(dist[frozenset(p)] for p in itertools.pairwise(c))  # noqa: B023, E731
        *free, last = sorted(text)
        chain = [got[d][k].version for k in sorted(got[d])]
        assert sorted(chain) == sorted(text) and chain[-1] == last and abs(got[d][1].total_distance - cost(chain)) < 1e-9
        if len(free) <= 8:
            best = min(cost([*p, last]) for p in itertools.permutations(free))
            assert chain == min([*p, last] for p in itertools.permutations(free) if cost([*p, last]) <= best + 1e-9) and got[d][1].basis == "exhaustive"


def test_attribution(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type", "value", "props").collect()
    each = defaultdict(lambda: ([], []))
    for r in rows:
        if r.event_id % 3 < 2:
            each[r.user_id][r.event_id % 3].append((r.event_id, r.event_type, r.event_id * 10, r.event_id * 10 + int(r.value), r.event_id % 2, words(f"{r.event_type} {r.props}" if r.props is not None else r.event_type)))
    want = set()
    for user, (a, b) in each.items():
        near = [(jaccard(x[5], y[5]), x[0], y[0]) for x in a for y in b if x[4] == y[4] and (x[1] == y[1] or (x[2] < y[3] and y[2] < x[3]))]
        kind = {y[0]: y[1] for y in b}
        want |= {(user, i, j, round(s, 9), kind[j]) for i, j, s in greedy([x for x in near if x[0] >= 0.5])}
    got = {(r.document_id, r.hunk, r.change, round(r.similarity, 9), r.author) for r in catalogue.QUERIES["hunk_attribution"](spark, sf).collect()}
    assert got == want and want


def test_induction(spark, sf):
    heads = {(r.page_id, norm(r.text)) for r in catalogue.QUERIES["html_clause_tree"](spark, sf).where("tag in ('title', 'li')").collect() if norm(r.text)}
    forms, led = sorted({h for _, h in heads}), {}
    bag = {h: words(h, HEADING_STOP_WORDS) for h in forms}
    for h in forms:
        near = [(-len(bag[h] & bag[x]) / min(len(bag[h]), len(bag[x])), x) for x, y in led.items() if x == y and bag[h] and bag[x]]
        best = min((n for n in near if -n[0] >= 0.5), default=None)
        led[h] = best[1] if best else h
    docs, used = defaultdict(set), defaultdict(set)
    for d, h in heads:
        docs[led[h]].add(d)
        used[led[h]].add(h)
    total = len({d for d, _ in heads})
    got = {r.leader: (r.documents, r.forms, round(r.frequency, 9), r.status) for r in catalogue.QUERIES["taxonomy_induction"](spark, sf).collect()}
    assert got == {h: (len(d), len(used[h]), round(len(d) / total, 9), "custom" if len(d) / total >= 0.2 else "inactive") for h, d in docs.items()}
