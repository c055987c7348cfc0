"""Exactness of the searches against brute force, with crowded spots and tiny pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.operators import color_match, nearest, similarity, vector_search
from registry import all as _all  # noqa: F401
from registry.core import QUERIES
from tests.conftest import answers


@pytest.fixture(autouse=True)
def tiny_pieces(monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_SPLIT", 16)
    monkeypatch.setattr(vector_search, "PIECE", 40)
    monkeypatch.setattr(vector_search, "BLOCK", 8)


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    crowd = centers[0] + 0.05 * rng.normal(size=(120, 8))
    rest = centers[rng.integers(0, 6, 150)] + 0.3 * rng.normal(size=(150, 8))
    points = np.vstack([crowd, np.repeat(crowd[:1], 20, axis=0), rest])
    queries = np.vstack([centers, rng.normal(size=(30, 8)), points[:5]])
    return points, queries


def frames(rows, world):
    points, queries = world
    people = rows(
        "embedding_id long, customer_id long, embedding array<double>, is_active boolean, is_primary boolean",
        *[(i, i // 2, [float(x) for x in v], i % 7 != 3, i % 2 == 0) for i, v in enumerate(points)],
    )
    customers = rows(
        "customer_id long, email string, first_name string, last_name string, loyalty_tier string, points_balance long, is_active boolean",
        *[(i, f"{i}@x", f"f{i}", "l", "Gold", i, i % 9 != 4) for i in range(len(points) // 2 + 1)],
    )
    asked = rows("query_id long, embedding array<double>", *[(i, [float(x) for x in v]) for i, v in enumerate(queries)])
    return people, customers, asked


def cosines(world):
    points, queries = world
    a = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    b = points / np.linalg.norm(points, axis=1, keepdims=True)
    return a @ b.T


def allowed(i):
    return i % 7 != 3 and (i // 2) % 9 != 4


@pytest.mark.parametrize("threshold,k", [(0.7, 5), (0.95, 3), (0.2, 40)])
def test_topk_cosine(rows, world, threshold, k):
    people, customers, asked = frames(rows, world)
    got = answers(similarity.topk_cosine(asked, people, customers, threshold, k, dim=8), "query_id", "rank", "customer_id", F.round("similarity_score", 5))
    sims, want = cosines(world), []
    for q in range(sims.shape[0]):
        order = sorted((-round(s, 6), i // 2, i, s) for i, s in enumerate(sims[q]) if allowed(i) and s >= threshold)[:k]
        want += [(q, r + 1, c, round(float(s), 5)) for r, (_, c, _, s) in enumerate(order)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=repr)]


def test_best_match_and_missing_vectors(rows, world):
    people, customers, asked = frames(rows, world)
    extra = rows("query_id long, embedding array<double>", (900, None), (901, [0.0] * 8), (902, [1.0, 2.0]))
    got = {r.query_id: r for r in similarity.best_match(asked.unionByName(extra), people, customers, dim=8).collect()}
    sims = cosines(world)
    for q in range(sims.shape[0]):
        best = min((-round(s, 6), i // 2, i, s) for i, s in enumerate(sims[q]) if allowed(i))
        assert got[q].customer_id == best[1] and got[q].found == (best[3] >= 0.85)
    for q in (900, 901, 902):
        assert (got[q].found, got[q].customer_id, got[q].confidence_level) == (False, None, "NONE")


def test_topk_l2(rows, world):
    people, customers, asked = frames(rows, world)
    points, queries = world
    dist = np.linalg.norm(queries[:, None] - points[None], axis=2)
    for compat in (False, True):
        got = answers(similarity.topk_l2(asked, people, customers, 1.5, 4, compat, dim=8), "query_id", "rank", "customer_id", "distance")
        want = []
        for q in range(len(queries)):
            usable = [(round(float(x), 4), i // 2, i) for i, x in enumerate(dist[q]) if i % 2 == 0 and (compat or (i % 7 != 3 and x < 1.5))]
            want += [(q, r + 1, c, d) for r, (d, c, _) in enumerate(sorted(usable)[: 5 if compat else 4])]
        assert got == sorted(want, key=repr)


def test_similar_entities_never_returns_the_source(rows, world):
    people, customers, _ = frames(rows, world)
    sources = people.select(F.col("customer_id").alias("source_id"))
    got = similarity.similar_entities(sources, people, customers, 0.8, 3, dim=8).collect()
    assert got and all(r.source_id != r.customer_id for r in got)
    points, _ = world
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    source = 10  # embedding 20 is its active primary vector
    sims = unit @ unit[20]
    order = sorted((-round(s, 6), i // 2, i) for i, s in enumerate(sims) if allowed(i) and i // 2 != source and s >= 0.8)[:3]
    assert [(r.rank, r.customer_id) for r in sorted(got, key=lambda r: r.rank) if r.source_id == source] == [
        (n + 1, c) for n, (_, c, _) in enumerate(order)
    ]


def test_misfits_are_named(rows, world):
    people, customers, asked = frames(rows, world)
    odd = rows("embedding_id long, v array<double>", (1, [1.0] * 8), (2, [1.0]), (3, None), (4, [None] + [1.0] * 7))
    assert answers(vector_search.misfits(odd, "v", 8), "embedding_id", "error") == [
        (2, "Embedding must have 8 numbers"), (3, "Embedding must have 8 numbers"), (4, "Embedding has gaps"),
    ]
    assert similarity.topk_cosine(asked, people, customers, dim=7).count() == 0


@pytest.mark.parametrize("spread", [256, 40])
def test_color_match(rows, spread):
    rng = np.random.default_rng(5)
    shades = [tuple(int(x) for x in rng.integers(0, spread, 3)) for _ in range(150)] + [(10, 10, 10)] * 60
    products = rows(
        "product_id long, name string, brand string, category string, current_price double, is_active boolean",
        *[(i, f"n{i}", "b", ["lips", "face", "eyes", "nails"][i % 4], float(i), True) for i in range(len(shades))],
    )
    variants = rows("variant_id long, product_id long, color_hex string", *[(i, i, "#%02x%02x%02x" % s) for i, s in enumerate(shades)], (998, 1, None), (999, 2, "#12"))
    media = rows("product_id long, url string, is_primary boolean", (0, "a", True), (0, "b", True), (1, "c", False))
    colors = [(0, 0, 0), (255, 255, 255), (10, 10, 10), (200, 30, 90)]
    targets = rows("target_id long, target_hex string", *[(i, "%02x%02x%02x" % c) for i, c in enumerate(colors)], (9, "#GGGGGG"))
    got = answers(color_match.match_products(targets, products, variants, media, k=12), "target_id", "rank", "product_id", "image_url")
    place = {"face": 1, "lips": 2, "eyes": 3}
    want = []
    for t, color in [*enumerate(colors), (9, (128, 128, 128))]:
        found = []
        for i, s in enumerate(shades):
            cat = ["lips", "face", "eyes", "nails"][i % 4]
            if cat != "nails":
                d = sum((a - b) ** 2 for a, b in zip(color, s))
                found += [(d, place[cat], i, url) for url in (["a", "b"] if i == 0 else [None])]
        want += [(t, r + 1, i, url) for r, (_, _, i, url) in enumerate(sorted(found, key=lambda f: (*f[:3], f[3] or ""))[:12])]
    assert got == sorted(want, key=repr)


def test_dense_and_sparse_colours(rows):
    """Targets inside a dense cloud meet few points each; targets outside of it and rounded ranks are exact as well."""
    cloud = [(r, g, b) for r in range(96, 112) for g in range(96, 112) for b in range(96, 112) if (r + g + b) % 3]
    points = cloud + [(0, 0, 0), (255, 255, 255), (255, 255, 254)] + [(100, 100, 100)] * 9
    shades = rows("id long, r int, g int, b int", *[(i, *p) for i, p in enumerate(points)])
    asked = [(100, 100, 100), (104, 103, 101), (96, 111, 96), (95, 95, 95), (255, 250, 255), (0, 0, 3)]
    targets = rows("t long, tr int, tg int, tb int", *[(i, *c) for i, c in enumerate(asked)])
    for rounded in (False, True):
        got = answers(nearest.color_nearest(targets, shades, 5, ["id"], rounded), "t", "rank", "id")
        want = []
        for t, c in enumerate(asked):
            square = [sum((x - y) ** 2 for x, y in zip(c, p)) for p in points]
            near = sorted((round(q**0.5, 2) if rounded else q, i) for i, q in enumerate(square))
            want += [(t, n + 1, i) for n, (_, i) in enumerate(near[:5])]
        assert got == sorted(want, key=repr)
    met, rest = nearest._within_reach(targets.select("tr", "tg", "tb"), shades, 5, 0.0)
    assert met.count() < 200 and answers(rest) == [(0, 0, 3), (255, 250, 255), (95, 95, 95)]


def test_category_words():
    assert color_match.categories_for(None) == ("lips", "face", "eyes", "skincare")
    assert color_match.categories_for("") == ("lips", "face", "eyes", "skincare")
    assert "lips" in color_match.categories_for("LipStick")
    assert color_match.categories_for("face") == ("face",)
    assert color_match.categories_for("hats") == ("hats",)


def test_as_array_gives_empty_lists(rows):
    matches = rows("t long, rank int, v string", (1, 2, "b"), (1, 1, "a"))
    got = color_match.as_array(matches, "t", rows("t long", (1,), (2,))).orderBy("t").collect()
    assert [[m.v for m in r.matches] for r in got] == [["a", "b"], []]


def test_registered_searches_ask_with_every_vector(spark, rows, tmp_path):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(24, 64))
    vectors[12:] = vectors[:12] + 0.01
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows("vec_id long, embedding array<float>, label int", *[(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]).write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    rows(
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", *[(i, f"Customer#{i}", 0, 1.0, "A") for i in range(30)]
    ).write.parquet(f"{tmp_path}/customer.parquet")
    asked = {name: {r[0] for r in QUERIES[name](spark, str(tmp_path)).select(key).collect()} for name, key in (
        ("vector_best_match", "query_id"), ("vector_topk_cosine", "query_id"), ("vector_topk_l2", "query_id"),
        ("vector_topk_l2_compat", "query_id"), ("similar_entities", "source_id"),
    )}
    assert asked["vector_best_match"] == asked["vector_topk_l2_compat"] == set(range(23))
    assert len(asked["vector_topk_cosine"]) > 10 and len(asked["vector_topk_l2"]) > 5 and len(asked["similar_entities"]) > 5


@pytest.mark.parametrize("cosine,limit", [(True, None), (True, 0.4), (False, None), (False, -0.9), (False, -1e6)])
@pytest.mark.parametrize("size", [1.0, 1e-3, 1e4, 1e20])
def test_pieces_hold_the_first_of_every_tile(monkeypatch, cosine, limit, size):
    monkeypatch.setattr(vector_search, "RUN", 32)
    rng = np.random.default_rng(9)
    points = np.repeat(rng.normal(size=(60, 5)), 4, axis=0)  # every vector four times: ties
    points = np.vstack([points, points[:40] + 1e-9, rng.normal(size=(50, 5))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = points if cosine else points * size
    ids, who = rng.permutation(len(points)), rng.integers(0, 50, len(points))
    own = rng.integers(0, 50, 30)
    tile = points[rng.integers(0, len(points), 30)]
    places = 6 if cosine else 4
    piece = vector_search._Piece(points, ids, who, float(np.linalg.norm(tile, axis=1).max()), cosine, places)
    row, at, score = piece.best(tile, 7, limit, own)
    want = []
    for r, q in enumerate(tile):
        s = (points * q).sum(1) if cosine else -np.sqrt(((q - points) ** 2).sum(1))
        fine = [i for i in range(len(points)) if who[i] != own[r] and (limit is None or s[i] >= limit)]
        want += [(r, i) for i in sorted(fine, key=lambda i: (-np.floor(s[i] / 10.0**-places + 0.5), who[i], ids[i]))[:7]]
    assert list(zip(row.tolist(), at.tolist())) == want
