"""Change application against one-by-one models: conflicts of keys, updates as a set, status steps, dispatch, logs."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hearth import schemas as S
from hearth.operators import changes as M
from hearth.operators.conflicts import accepted_in_order, passed_on

T1 = datetime(2026, 7, 1, 12, 0, 0)


# ----------------------------------------------------------------------------- inserts in order

def one_by_one(rows):
    """(rid, o, a, b) in order: refused rid -> labels of the keys an earlier accepted row holds."""
    taken, out = {"A": set(), "B": set()}, {}
    for rid, _, a, b in sorted(rows, key=lambda r: r[1]):
        why = {k for k, v in (("A", a), ("B", b)) if v is not None and v in taken[k]}
        if why:
            out[rid] = why
        else:
            for k, v in (("A", a), ("B", b)):
                if v is not None:
                    taken[k].add(v)
    return out


def in_order(spark, rows):
    df = spark.createDataFrame(rows, "rid bigint, o bigint, a bigint, b string").repartition(4)
    late, rounds = accepted_in_order(df, [(["a"], "A"), (["b"], "B")])
    out = {}
    for r in late.collect():
        out.setdefault(r.rid, set()).add(r.why)
    return out, rounds


@pytest.mark.parametrize("seed_", range(3))
def test_inserts_take_keys_in_order(spark, seed_):
    rng = random.Random(seed_)
    order = list(range(120))
    rng.shuffle(order)
    rows = [(k, order[k], rng.choice([None, *range(25)]), rng.choice([None, *"abcdefghijklmnopqrst"])) for k in range(120)]
    got, _ = in_order(spark, rows)
    assert got == one_by_one(rows)


def test_a_long_chain_of_clashes_takes_few_rounds(spark):
    # row k shares a with k - 1 and b with k + 1: one by one, every other row is accepted
    rows = [(k, k, k // 2, str((k + 1) // 2)) for k in range(10_000)]
    got, rounds = in_order(spark, rows)
    assert got == one_by_one(rows) and len(got) == 5_000
    assert sum(rounds.values()) < 20


def test_a_hot_key_is_decided_in_one_round(spark):
    rows = [(k, -k, 1 if k % 3 == 0 else 1000 + k, str(k)) for k in range(3000)]
    got, rounds = in_order(spark, rows)
    assert got == one_by_one(rows) and rounds == {"rounds": 1, "component_rounds": 0}


# ----------------------------------------------------------------------------- updates as a set

def set_model(current, wants):
    """current: id -> key; wants: id -> (o, key or None). Ids that do not get what they want."""
    first = {}
    for i, (_, w) in sorted(wants.items(), key=lambda x: (x[1][0], x[0])):
        if w is not None:
            first.setdefault(w, i)
    lost = {i for i, (_, w) in wants.items() if w is not None and first[w] != i}
    while True:                                 # a refused row keeps its key, which refuses who wants it
        kept = {}
        for i, k in current.items():
            if i not in wants or i in lost:
                kept.setdefault(k, i)
        more = {i for i, (_, w) in wants.items() if i not in lost and w is not None and w in kept}
        if not more:
            return lost
        lost |= more


@pytest.mark.parametrize("seed_", range(4))
def test_keys_are_passed_on_as_a_set(spark, seed_):
    rng = random.Random(seed_)
    current = {i: f"k{i}" for i in range(80)}
    free = [f"free{i}" for i in range(10)]
    movers = rng.sample(range(80), 60)
    wants = {}
    for i in movers:
        w = rng.choice([f"k{rng.randrange(80)}", f"k{(i + 1) % 80}", f"k{i ^ 1}", rng.choice(free), None])
        if w != current[i]:
            wants[i] = (rng.randrange(20), w)
    m = spark.createDataFrame([(i, o, w) for i, (o, w) in wants.items()], "id bigint, n bigint, want string")
    m = m.select("id", F.struct("n", "id").alias("o"), "want")
    h = spark.createDataFrame([(k, i) for i, k in current.items()], "want string, holder bigint")
    got = {r.id for r in passed_on(m, h)[0].collect()}
    assert got == set_model(current, wants)


@pytest.mark.parametrize("end,lost", [("free", 0), ("k2000", 2000), ("k0", 0)])       # a chain, a blocked one, one ring
def test_long_chains_of_passed_keys(spark, end, lost):
    n = 2000
    m = spark.createDataFrame([(i, f"k{i + 1}" if i < n - 1 else end) for i in range(n)], "id bigint, want string")
    h = spark.createDataFrame([(f"k{i}", i) for i in range(n + 1)], "want string, holder bigint")
    out, rounds = passed_on(m.select("id", F.struct("id").alias("o"), "want"), h)
    assert out.count() == lost and rounds <= 12


def residents(spark, rows):
    return spark.createDataFrame(rows, "resident_id bigint, seq int, id_card string, gender string, room_id bigint")


def test_updates_are_checked_and_may_swap(spark, seed):
    cards = {r.resident_id: r.id_card for r in seed["residents"].collect()}
    g = {r.resident_id: r.gender for r in seed["residents"].collect()}
    rooms = {r.resident_id: r.room_id for r in seed["residents"].collect()}
    batch = residents(spark, [
        (1, 1, cards[2], g[1], rooms[1]), (2, 1, cards[1], g[2], rooms[2]),              # swap
        (3, 1, cards[4], g[3], rooms[3]),                                                  # 4 stays: refused
        (5, 1, cards[6], g[5], rooms[5]), (6, 1, "new", "未知", rooms[6]),                 # 6 is refused, so it keeps its card
        (7, 2, "one", g[7], rooms[7]), (8, 1, "one", g[8], rooms[8]),                      # 8 comes first
        (9, 1, cards[9], g[9], 999), (10, 1, None, g[10], rooms[10]),                      # reference, null
        (11, 1, cards[12], g[11], rooms[11]), (11, 2, cards[11], "女", rooms[11]),         # the last change counts
        (404, 1, cards[1], "男", 1), (None, 1, "x", "男", 1)])
    out = M.validated_updates(seed, batch, "residents")
    assert {r.resident_id: list(r.reasons) for r in out["rejected"].collect()} == {
        3: ["UNIQUE:id_card"], 5: ["UNIQUE:id_card"], 6: ["ENUM:gender"], 7: ["UNIQUE:id_card"], 9: ["FK:room_id"], 10: ["NULL:id_card"]}
    after = {r.resident_id: r for r in out["table"].collect()}
    assert (after[1].id_card, after[2].id_card) == (cards[2], cards[1])
    assert after[8].id_card == "one" and after[7].id_card == cards[7] and after[11].gender == "女"
    assert len(after) == len(cards) and after[5].id_card == cards[5] and after[9].room_id == rooms[9]
    assert after[1].name == {r.resident_id: r.name for r in seed["residents"].collect()}[1]


def test_composite_unique_under_the_collation(spark, seed):
    rooms = seed["rooms"].collect()
    a, b = [r for r in rooms if r.unit_id == 1][:2]
    batch = spark.createDataFrame([(a.room_id, "X1 "), (b.room_id, "x1")], "room_id bigint, room_number string")
    out = M.validated_updates(seed, batch, "rooms")
    assert [r.room_id for r in out["rejected"].collect()] == [b.room_id]
    moved = spark.createDataFrame([(a.room_id, 2)], "room_id bigint, unit_id bigint")      # 2 has the same room number
    assert [list(r.reasons) for r in M.validated_updates(seed, moved, "rooms")["rejected"].collect()] == [["UNIQUE:unit_id,room_number"]]


def test_updates_row_rules_of_carried_columns(spark, seed):
    batch = spark.createDataFrame([(1, "-3"), (2, "50")], "room_id bigint, area string")
    out = M.validated_updates(seed, batch, "rooms")
    assert [(r.room_id, list(r.reasons)) for r in out["rejected"].collect()] == [(1, ["CHECK:area_positive"])]
    none = M.validated_updates(seed, batch.where("room_id < 0"), "rooms")
    assert none["rejected"].count() == 0 and none["table"].count() == seed["rooms"].count()


# ----------------------------------------------------------------------------- status steps

@pytest.mark.parametrize("ranges", [1, 7])
def test_steps_by_ranges_equal_one_by_one(spark, monkeypatch, ranges):
    monkeypatch.setattr(M, "RANGES", ranges)
    rng = random.Random(ranges)
    states = ["a", "b", "done", None]
    rows = [(k, rng.choice([None, *range(30)]) if k else s, rng.choice(states), rng.randrange(5)) for k in range(6) for s in range(40)]
    df = spark.createDataFrame(rows, "order_id bigint, seq int, status string, n int").repartition(5)
    got = {r.order_id: (r["__last"]["status"], r["__last"]["n"], r["__first"], r["__later"])
           for r in M._steps(df, "order_id", "done", lambda p: p != "done").collect()}
    low = lambda x: (x is not None, x if x is not None else 0)                            # noqa: E731
    text = lambda x: (x is not None, x or "")                                              # noqa: E731
    for k in range(6):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (low(r[1]), text(r[2]), r[3]))
        later = any(p[2] is not None and p[2] != "done" and q[2] == "done" for p, q in zip(mine, mine[1:], strict=False))
        assert got[k] == (mine[-1][2], mine[-1][3], mine[0][2], later)


def test_a_hot_key_is_cut_into_ranges(spark):
    """No window over one key sees a third of the batch: its steps stand in many groups."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("bigint").alias("order_id"),
                                    F.col("id").cast("int").alias("seq"),
                                    F.when(F.col("id") % 2 == 0, "x").otherwise("已完成").alias("status"))
    plan = M._steps(df, "order_id", S.ORDER_DONE, lambda p: p != S.ORDER_DONE)._jdf.queryExecution().optimizedPlan().toString()
    first = [x for x in plan.splitlines() if "windowspecdefinition" in x][-1]
    assert "order_id" in first and "__r" in first
    assert M._steps(df, "order_id", S.ORDER_DONE, lambda p: p != S.ORDER_DONE).where("order_id = 1").first()["__later"]


# ----------------------------------------------------------------------------- dispatch

def test_dispatch_runs_what_a_change_sets_off(spark, seed):
    from hearth.operators.dispatch import apply_all, apply_changes
    staff = spark.createDataFrame([(1, 2, "离职"), (1, 1, "未知"), (404, 1, "离职")], "staff_id bigint, seq int, status string")
    one = seed["staff"].where("staff_id = 1").first()
    assert one.status == "在职"
    a = apply_changes(seed, "staff", staff, as_of=T1)
    assert a.trail == ["staff update", "repair_orders update"] and set(a.tables) == {"staff", "repair_orders"}
    assert [(r.staff_id, list(r.reasons)) for r in a.rejected.collect()] == [(1, ["ENUM:status"])]
    want = M.staff_resignation(seed["staff"], staff.where("status = '离职'"), seed["repair_orders"])
    for name in ("staff", "repair_orders"):
        assert sorted(map(str, a.tables[name].collect())) == sorted(map(str, want[name].collect()))
    done = spark.createDataFrame([(3, "已完成")], "order_id bigint, status string")
    b = apply_changes(seed, "repair_orders", done, as_of=T1).tables["repair_orders"].where("order_id = 3").first()
    assert (b.status, b.completed_at) == ("已完成", T1)
    new = spark.createDataFrame([(900, 4, "n", "男", "1", "x9", date(2026, 7, 1)), (901, 999, "n", "男", "1", "x8", date(2026, 7, 1))],
                                "resident_id bigint, room_id bigint, name string, gender string, phone string, id_card string, move_in_date date")
    c = apply_all(seed, [("residents", "insert", new), ("complaints", "update", spark.createDataFrame([(3, "已解决")], "complaint_id bigint, status string"))], T1)
    assert c.trail == ["residents insert", "rooms update", "complaints update"]
    assert c.tables["rooms"].where("room_id = 4").first().status == "已入住"
    assert c.tables["complaints"].where("complaint_id = 3").first().resolved_at == T1
    assert [(r.table_name, r.row_key, list(r.reasons)) for r in c.rejected.collect()] == [("residents", 901, ["FK:room_id"])]


def test_dispatch_prices_and_settles_bills(spark, seed):
    from hearth.operators.dispatch import apply_changes
    bills = spark.createDataFrame([(9001, 1, 1, "0", "2026-07", date(2026, 7, 25))],
                                  "fee_id bigint, resident_id bigint, category_id bigint, amount string, fee_period string, due_date date")
    t = dict(seed) | apply_changes(seed, "fee_records", bills, "insert", T1).tables
    assert str(t["fee_records"].where("fee_id = 9001").first().amount) == "223.75"
    paid = spark.createDataFrame([(9001, "223.75")], "fee_id bigint, paid_amount string")
    after = apply_changes(t, "fee_records", paid, as_of=T1).tables["fee_records"]
    row = after.where("fee_id = 9001").first()
    assert (row.status, row.paid_date) == ("已缴", T1.date())
    assert sorted(map(str, after.where("fee_id <> 9001").collect())) == sorted(map(str, seed["fee_records"].collect()))
    with pytest.raises(ValueError):
        apply_changes(seed, "rooms", paid, "delete")


# ----------------------------------------------------------------------------- change log

def replay(residents, spaces, vehicles, log):
    """The log one event at a time over {key: row}; vehicles are dicts."""
    refused = []
    for seq, table, op, key, row, fields in sorted(log, key=lambda e: e[0]):
        if table in ("residents", "parking_spaces"):
            mine = residents if table == "residents" else spaces
            if op == "D" and key in mine:
                mine.remove(key)
                for k in list(vehicles):
                    if table == "residents" and vehicles[k]["resident_id"] == key:
                        del vehicles[k]
                    elif table == "parking_spaces" and vehicles[k]["space_id"] == key:
                        vehicles[k]["space_id"] = None
            elif op == "I" and key in mine:
                refused.append((table, key, seq, "PK"))
            elif op == "I":
                mine.add(key)
            continue
        if op == "D":
            vehicles.pop(key, None)
            continue
        if op == "U" and key not in vehicles:
            continue
        if op == "I" and key in vehicles:
            refused.append((table, key, seq, "PK"))
            continue
        new = {f: row[f] for f in (fields or row)}
        if new.get("vehicle_type", "SUV") != "SUV":
            refused.append((table, key, seq, "ENUM:vehicle_type"))
        elif "resident_id" in new and new["resident_id"] not in residents:
            refused.append((table, key, seq, "FK:resident_id"))
        elif new.get("space_id") is not None and new["space_id"] not in spaces:
            refused.append((table, key, seq, "FK:space_id"))
        else:
            vehicles[key] = vehicles.get(key, {}) | new
    return vehicles, refused


@pytest.mark.parametrize("seed_", range(3))
def test_a_mixed_log_equals_its_replay(spark, seed, seed_):
    from hearth.operators.changelog import apply_log
    rng = random.Random(seed_)
    t = dict(seed)
    res = {r.resident_id for r in t["residents"].collect()}
    spc = {r.space_id for r in t["parking_spaces"].collect()}
    veh = {r.vehicle_id: {c: r[c] for c in ("resident_id", "space_id", "plate_no", "vehicle_type", "color")} for r in t["vehicles"].collect()}
    keys = [*veh, 501, 502, 503]
    r0 = t["residents"].first()
    log = []
    for seq in range(160):
        kind = rng.random()
        if kind < 0.2:
            log.append((seq, "residents", rng.choice("DI"), rng.choice(sorted(res)[:6]), {}, None))
        elif kind < 0.3:
            log.append((seq, "parking_spaces", rng.choice("DI"), rng.choice(sorted(spc)[:5]), {}, None))
        else:
            row = {"resident_id": rng.choice([*sorted(res)[:7], 999]), "space_id": rng.choice([None, *sorted(spc)[:6], 999]),
                   "plate_no": f"p{seq}", "vehicle_type": "SUV" if rng.random() < 0.95 else "坦克", "color": rng.choice([None, f"c{seq}"])}
            op = rng.choice("IUUUD")
            fields = None if op != "U" else rng.sample(sorted(row), rng.randint(1, 3))
            log.append((seq, "vehicles", op, rng.choice(keys), row, fields))
    of = lambda name: [e for e in log if e[1] == name]                                        # noqa: E731
    frames = {
        "residents": spark.createDataFrame([(s, op, k, r0.room_id, "n", "男", "1", f"card{s}", "业主", r0.move_in_date) for s, _, op, k, _, _ in of("residents")],
                                           "seq int, op string, resident_id bigint, room_id bigint, name string, gender string, phone string, id_card string, relationship string, move_in_date date"),
        "parking_spaces": spark.createDataFrame([(s, op, k, f"s{s}", "a") for s, _, op, k, _, _ in of("parking_spaces")],
                                                "seq int, op string, space_id bigint, space_number string, area_name string"),
        "vehicles": spark.createDataFrame([(s, op, k, *x.values(), f) for s, _, op, k, x, f in of("vehicles")] + [(None, "I", 7, 1, None, "p", "SUV", None, None)],
                                          "seq int, op string, vehicle_id bigint, resident_id bigint, space_id bigint, plate_no string, vehicle_type string, color string, fields array<string>")}
    out = apply_log(t, frames, T1)
    want, refused = replay(set(res), set(spc), {k: dict(v) for k, v in veh.items()}, log)
    got = {r.vehicle_id: {c: r[c] for c in ("resident_id", "space_id", "plate_no", "vehicle_type", "color")} for r in out["vehicles"].collect()}
    assert got == want
    mine = {(r.table_name, r.row_key, r.seq, r.reason) for r in out["rejected"].where("seq is not null").collect()}
    assert mine == set(refused)
    assert out["rejected"].where("reason = 'NO_KEY'").count() == 1
    assert set(out) == {"residents", "parking_spaces", "vehicles", "fee_records", "repair_orders", "complaints", "visitor_records", "rejected"}
    alive = {r.resident_id for r in out["residents"].collect()}
    assert out["fee_records"].join(out["residents"], "resident_id", "left_anti").count() == 0 and alive


def test_cascades_reach_down_the_whole_tree(spark, seed):
    from hearth.operators.changelog import apply_log
    out = apply_log(seed, {"buildings": spark.createDataFrame([(5, "D", 1)], "seq int, op string, building_id bigint")}, T1)
    want = M.cascade_delete(seed, "buildings", [1])
    for name, df in out.items():
        if name != "rejected":
            assert sorted(map(str, df.collect())) == sorted(map(str, want[name].select(*df.columns).collect())), name
