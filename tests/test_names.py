from pyspark.sql import functions as F

from merchlens.operators.names import resolve_names, resolve_sessions
from tests.conftest import answers

ID = "026912b9-b508-421e-b807-7d265158b96a"


def test_cascade(rows):
    products = rows("id string, name string", (ID, "Luxe Foundation"), ("p2", "luxe foundation"), ("p3", "Pro Luxe Foundation 100%"), ("p4", "Ab"))
    refs = rows("ref string", (ID,), (ID.replace("0", "1"),), ("LUXE foundation",), ("pro luxe",), ("100%",), ("b",), ("zzz",), (None,), ("",))
    got = {r.ref: (r.id, r.how, r.error) for r in resolve_names(refs, products).collect()}
    assert got[ID] == (ID, "id", None)
    assert got[ID.replace("0", "1")][2].startswith("Product not found with ID")
    assert got["LUXE foundation"] == (ID, "exact", None)
    assert got["pro luxe"] == ("p3", "contains", None)
    assert got["100%"] == ("p3", "contains", None)
    assert got["b"] == ("p4", "contains", None)
    assert got["zzz"] == (None, None, "Product not found: zzz")
    assert got[None] == (None, None, "Product not found: ")


def test_scope_and_newest_first(rows):
    items = rows("id string, name string, session_id long, at int", ("a", "Lip", 1, 1), ("b", "Lip", 1, 9), ("c", "Lip", 2, 5), ("d", "Lip Kit", 2, 7))
    refs = rows("ref string, session_id long", ("lip", 1), ("lip", 2), ("kit", 1), ("kit", 2))
    newest = resolve_names(refs, items, scope=["session_id"], order=[-F.col("at")], what="Cart item")
    assert answers(newest, "ref", "session_id", "id", "error") == [
        ("kit", 1, None, "Cart item not found: kit"), ("kit", 2, "d", None), ("lip", 1, "b", None), ("lip", 2, "c", None),
    ]


def test_no_ref_meets_every_name(rows):
    plan = resolve_names(rows("ref string", ("a",)), rows("id string, name string", ("1", "abc")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pieces_of_all_lengths_and_scopes_of_all_sizes(rows):
    """References of every length, as a brute force finds them; nothing that grows is broadcast."""
    names = [(f"{i}", f"{w} {i * 7919 % 1000} item", 1 if i % 9 else 2) for i in range(150) for w in ("Alpha Beta", "gamma")]
    names.append(("x", None, 2))
    asked = sorted({(n[a : a + m], s) for _, n, s in names[:60:7] for a in (0, 3) for m in (1, 2, 3, 5, 6, 9, 12, 14)} | {("almond nowhere", 1), ("mma 9x", 2)})
    low = [(i, n.lower() if n else "", s) for i, n, s in names]
    found = resolve_names(rows("ref string, s int", *asked), rows("id string, name string, s int", *names), scope=["s"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {(r.ref, r.s): r.id for r in found.collect()}
    for ref, s in asked:
        exact = [i for i, n, t in low if t == s and n == ref.lower()]
        assert got[ref, s] == min(exact or [i for i, n, t in low if t == s and ref.lower() in n], default=None), ref
    assert "Broadcast" not in plan
    alone = resolve_names(rows("ref string", *[(r,) for r, _ in asked]), rows("id string, name string", *[n[:2] for n in names]))
    assert "Broadcast" not in alone._jdf.queryExecution().executedPlan().toString()
    for r in alone.collect():
        assert r.id == min([i for i, n, _ in low if r.ref.lower() in n], default=None), r.ref


def test_sessions(rows):
    sessions = rows(
        "session_id string, customer_id string, status string, created_at int",
        ("s1", "c1", "active", 1), ("s2", "c1", "active", 2), ("s3", "c1", "completed", 3), ("s4", "c2", "completed", 1),
    )
    got = resolve_sessions(rows("ref string", ("s3",), ("c1",), ("c2",)), sessions)
    assert answers(got, "ref", "session_id", "how", "error") == [
        ("c1", "s2", "customer", None), ("c2", None, None, "Cart session not found: c2"), ("s3", "s3", "session", None),
    ]
