"""Review commands against a plain model, and two writers at one revision."""

from __future__ import annotations

import random
import threading
from collections import Counter
from copy import deepcopy

import pytest

from ledgerloom.operators import commands
from ledgerloom.sources.review_log import ReviewLog

RECORD = "workspace_id string, record_id string, file_id string, page int, parse_status string, transaction_at string, booking_at string, amount string, direction string, currency string, balance string, transaction_status string"
NAMES = [x.split()[0] for x in commands.COMMAND.replace("map<string, string>", "map").split(", ")]
GOOD = {"transaction_at": "2026-01-02", "amount": "5.00", "direction": "out", "currency": "CNY"}


def command(ws, seq, request, expected, action, **more):
    return {n: None for n in NAMES} | {"workspace_id": ws, "seq": seq, "request_id": request, "expected_revision": expected, "action": action, "note": "seen"} | more


@pytest.fixture(scope="module")
def batch(spark):
    records = [(ws, f"r{i}", f"f{i % 2}", i % 3, "needs_review" if i % 2 else "ready", "2026-01-01", None, None if i % 4 == 1 else "1.00", "in", "CNY", None, None) for ws in ("a", "b", "c") for i in range(9)]
    tasks = [(ws, f"p{f}{p}", f"f{f}", p) for ws in ("a", "b", "c") for f in (0, 1) for p in (0, 1, 2, 9)]
    files = [(ws, f, f == "f1", 4 if f == "f1" else None) for ws in ("a", "b", "c") for f in ("f0", "f1")]
    return (
        spark.createDataFrame(records, RECORD),
        spark.createDataFrame(tasks, "workspace_id string, review_id string, file_id string, page int"),
        spark.createDataFrame(files, "workspace_id string, file_id string, needs_page boolean, n_pages int"),
        records,
    )


def valid(values: dict) -> bool:
    text = lambda f: (values.get(f) or "").strip()
    day = lambda t: t.startswith("2026-")  # noqa: E731  the only dates here
    money = lambda t: t.replace(".", "", 1).isdigit()
    ok = all(not text(f) or day(text(f)) for f in ("transaction_at", "booking_at")) and (text("transaction_at") or text("booking_at"))
    return bool(ok and money(text("amount")) and text("direction") in ("in", "out", "none") and text("currency") in ("CNY", "USD") and text("transaction_status") in ("", "posted"))


def model(rows: list[dict], records) -> list[tuple]:
    """Whole states kept for each revision, and every rule looked up in them."""
    out, books = [], {}
    for c in sorted(rows, key=lambda c: (c["workspace_id"], c["seq"])):
        ws = c["workspace_id"]
        states, seen, stack_of = books.setdefault(ws, ([{"over": {}, "gone": set(), "manual": {}, "pages": set(), "stack": []}], {}, None))
        base = {r[1]: {"page": (r[2], r[3]), "open": r[4] != "ready", **dict(zip(("transaction_at", "booking_at", "amount", "direction", "currency", "balance", "transaction_status"), r[5:]))} for r in records if r[0] == ws}
        payload = tuple((n, tuple(sorted(c[n].items())) if isinstance(c[n], dict) else c[n]) for n in NAMES if n != "seq")
        state, outcome = deepcopy(states[-1]), None
        rows_now = {k: {"page": v["page"], "open": v["open"] and k not in state["over"]} for k, v in base.items()} | {k: {"page": p, "open": False} for k, p in state["manual"].items()}
        rid, action = c["record_id"], c["action"]
        if not c["request_id"] or len(c["request_id"]) < 8:
            outcome = "request_invalid"
        elif action != "confirm" and not (c["note"] or "").strip():
            outcome = "note_missing"
        elif c["request_id"] in seen:
            same = seen[c["request_id"]]
            out.append((ws, c["seq"], "replayed", same[1]) if same[0] == payload else (ws, c["seq"], "request_reused", None))
            continue
        elif c["expected_revision"] != len(states) - 1:
            outcome = "stale"
        elif action == "undo":
            if not state["stack"] or state["stack"][-1] != c["target_revision"]:
                outcome = "undo_not_newest"
            else:
                state = deepcopy(states[c["target_revision"] - 1])
        elif action in ("confirm", "exclude"):
            values = {**base.get(rid, {}), **state["over"].get(rid, {}), **(c["fields"] or {})}
            if rid not in rows_now:
                outcome = "record_unknown"
            elif action == "confirm" and (not valid(values) or set(c["fields"] or {}) - set(commands.FIELDS)):
                outcome = "fields_invalid"
            else:
                state["pages"] = {t for t in state["pages"] if t[1] != rows_now[rid]["page"]}
                if action == "confirm":
                    state["over"][rid] = {**state["over"].get(rid, {}), **(c["fields"] or {})}
                    state["gone"].discard(rid)
                else:
                    state["gone"].add(rid)
        elif action == "add":
            if c["file_id"] not in ("f0", "f1"):
                outcome = "file_unknown"
            elif c["page"] is None and c["file_id"] == "f1" or c["page"] is not None and not 1 <= c["page"] <= (4 if c["file_id"] == "f1" else 300):
                outcome = "page_invalid"
            elif not valid(c["fields"] or {}):
                outcome = "fields_invalid"
            else:
                name = f"manual of {c['request_id']}"
                state["manual"][name], state["over"][name] = (c["file_id"], c["page"]), c["fields"]
                state["pages"] = {t for t in state["pages"] if t[1] != (c["file_id"], c["page"])}
        elif action == "resolve_page":
            tasks = {f"p{f}{p}": (f"f{f}", p) for f in (0, 1) for p in (0, 1, 2, 9)}
            here = [k for k, v in rows_now.items() if v["page"] == tasks.get(c["review_id"]) and k not in state["gone"]]
            if c["review_id"] not in tasks:
                outcome = "page_unknown"
            elif any(rows_now[k]["open"] for k in here):
                outcome = "page_pending"
            elif c["observed_count"] != len(here):
                outcome = "count_mismatch"
            else:
                state["pages"].add((c["review_id"], tasks[c["review_id"]]))
        else:
            outcome = "action_unknown"
        if outcome is None:
            if action != "undo":
                state["stack"].append(len(states))
            seen[c["request_id"]] = payload, len(states)
            states.append(state)
            outcome = "applied"
        out.append((ws, c["seq"], outcome, len(states) - 1 if outcome == "applied" else None))
    return out, {ws: b[0] for ws, b in books.items()}


def random_commands(seed: int, n: int) -> list[dict]:
    chance, rows = random.Random(seed), []
    for ws in ("a", "b", "c"):
        revision, stack, sent = 0, [], []
        for seq in range(n):
            if sent and chance.random() < 0.1:
                rows.append({**chance.choice(sent), "seq": seq})  # again, now or later
                continue
            action = chance.choice(["confirm"] * 4 + ["exclude"] * 2 + ["undo"] * 3 + ["add"] * 2 + ["resolve_page"] * 4 + ["other"])
            fields = chance.choice([None, {"amount": "7.00"}, {"amount": "x"}, {"amount": None}, {"amount": "3", "currency": "USD"}, {"colour": "red"}, GOOD, GOOD, {**GOOD, "direction": "up"}])
            c = command(
                ws, seq, f"request-{seq}" if chance.random() < 0.93 else chance.choice(["short", None, "request-1"]), revision if chance.random() < 0.85 else chance.randint(0, revision + 1), action,
                note=chance.choice(["seen", "seen", "seen", " "]), record_id=f"r{chance.randint(0, 9)}", review_id=f"p{chance.randint(0, 1)}{chance.choice([0, 1, 2, 9, 7])}",
                target_revision=(stack[-1] if stack else 0) if chance.random() < 0.8 else revision, observed_count=chance.randint(0, 3), file_id=f"f{chance.choice([0, 1, 1, 2])}", page=chance.choice([None, 1, 2, 5]), fields=fields,
            )
            before = model([r for r in rows if r["workspace_id"] == ws] + [c], FIXED)
            if before[0][-1][2] == "applied":
                revision = before[0][-1][3]
                stack = before[1][ws][-1]["stack"]
            rows.append(c)
            sent.append(c)
    return rows


FIXED: list = []


def test_replay_is_that_of_the_plain_model(spark, batch):
    FIXED[:] = batch[3]
    rows = random_commands(11, 70)
    replayed = commands.replay_commands(spark.createDataFrame(rows, commands.COMMAND), *batch[:3]).cache()
    expected, states = model(rows, batch[3])
    assert sorted((r.workspace_id, r.seq, r.outcome, r.revision) for r in replayed.collect()) == sorted(expected)
    assert len({o[2] for o in expected}) >= 13, Counter(o[2] for o in expected)

    # The state at every revision, for a few of them.
    for revision in (None, 3, 9):
        found = {(r.workspace_id, r.record_id): r for r in commands.record_states(replayed, revision).collect() if not r.manual}
        pages = {(r.workspace_id, r.review_id) for r in commands.resolved_pages(replayed, batch[0], batch[1], revision).collect()}
        for ws in ("a", "b", "c"):
            state = states[ws][min(revision, len(states[ws]) - 1) if revision is not None else -1]
            named = {k: v for k, v in state["over"].items() if not k.startswith("manual")}
            assert {k: v.fields for (w, k), v in found.items() if w == ws and v.confirmed} == named
            assert {k for (w, k), v in found.items() if w == ws and v.excluded} == {k for k in state["gone"] if not k.startswith("manual")}
            assert {t for w, t in pages if w == ws} == {t for t, _ in state["pages"]}
    assert {r.workspace_id: r.undo_revision for r in commands.undo_revision(replayed).collect()} == {ws: s[-1]["stack"][-1] for ws, s in states.items() if s[-1]["stack"]}


def test_no_commands(spark, batch):
    none = commands.replay_commands(spark.createDataFrame([], commands.COMMAND), *batch[:3])
    assert none.count() == 0 and commands.record_states(none).count() == 0 and commands.resolved_pages(none, batch[0], batch[1]).count() == 0


def test_log_is_written_once_for_each_revision(spark, batch, tmp_path):
    log = ReviewLog(spark, f"file://{tmp_path}/log", *batch[:3])
    assert log.apply(command("a", None, "request-1", 0, "confirm", record_id="r0")) == ("applied", 1)
    assert log.apply(command("a", None, "request-1", 0, "confirm", record_id="r0")) == ("replayed", 1)
    assert log.apply(command("a", None, "request-1", 1, "confirm", record_id="r2")) == ("request_reused", None)
    assert log.apply(command("a", None, "request-2", 0, "exclude", record_id="r2")) == ("stale", None)
    got: list = []
    writers = [threading.Thread(target=lambda k=k: got.append(log.apply(command("a", None, f"request-by-{k}", 1, "exclude", record_id=f"r{k}")))) for k in (2, 3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(got) == [("applied", 2), ("stale", None)]
    assert log.apply(command("a", None, "request-5", 2, "undo", target_revision=2)) == ("applied", 3)
    assert log.apply(command("b", None, "request-6", 0, "add", file_id="f1", page=2, fields=GOOD)) == ("applied", 1)
    assert sorted((r.workspace_id, r.revision) for r in log.replayed().collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert [(r.workspace_id, r.excluded, r.confirmed, r.manual) for r in commands.record_states(log.replayed()).orderBy("workspace_id").collect()] == [("a", False, True, False), ("b", False, True, True)]
