"""Review commands over an immutable batch: what a log of them leads to, command by command.

A command is applied if it names the revision that it was made for, that revision still stands, and what it asks
for is valid then; it makes the next revision. A request that was applied once changes nothing again. An undo
takes back the newest revision that still stands, as if it had not been.

What can be judged apart from the log (which records, pages and files there are, which stated fields can be read)
is joined to all commands at once. What depends on the commands before goes through a fold in their order: one
pass over the sorted rows of a workspace, whose state holds the applied requests and what they touched. Workspaces
are apart. The state at any revision is then a join of the applied commands again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_struct
from ..functions.money import with_money
from ..shipping import ship
from .review import LONGEST_TEXT, STATED_CURRENCIES, STATED_STATUSES

#: Fixed value: the fields that a person may change.
FIELDS = ("transaction_at", "booking_at", "amount", "direction", "currency", "balance", "counterparty", "description", "account", "source_record_id", "transaction_status")
REQUEST = "^[A-Za-z0-9-]{8,80}$"
MOST_PAGES = 300
COMMAND = (
    "workspace_id string, seq long, request_id string, expected_revision long, action string, note string, record_id string, review_id string, "
    "target_revision long, observed_count long, file_id string, page long, fields map<string, string>"
)
_PAYLOAD = [c.split()[0] for c in COMMAND.replace("map<string, string>", "map").split(", ") if c.split()[0] not in ("seq",)]
#: Fields whose reading decides whether a record may be confirmed.
_JUDGED = ("transaction_at", "booking_at", "amount", "direction", "currency", "balance", "transaction_status")


def field_states(rows: DataFrame, value) -> DataFrame:
    """rows with _s_<field> for the judged fields: 'ok', 'bad' or 'blank' of the text value(field)."""
    staged = rows.withColumns({f"_v_{f}": F.nullif(F.trim(value(f)), F.lit("")) for f in _JUDGED})
    staged = with_money(staged, {"_m_amount": "_v_amount", "_m_balance": "_v_balance"})
    c = F.col
    good = {
        **{f: date_struct(c(f"_v_{f}"))["at"].isNotNull() for f in ("transaction_at", "booking_at")},
        "amount": c("_m_amount.amount") >= 0,
        "balance": c("_m_balance.amount").isNotNull(),
        "direction": c("_v_direction").isin("in", "out", "none"),
        "currency": c("_v_currency").isin(*STATED_CURRENCIES),
        "transaction_status": c("_v_transaction_status").isin(*STATED_STATUSES),
    }
    states = {f"_s_{f}": F.when(c(f"_v_{f}").isNull(), "blank").when(F.coalesce(g, F.lit(False)), "ok").otherwise("bad") for f, g in good.items()}
    return staged.withColumns(states).drop(*[f"_v_{f}" for f in _JUDGED], "_m_amount", "_m_balance")


def _states(only: Column | None = None) -> Column:
    """The states as map<field, state>, of those fields only that a map states."""
    entries = F.map_from_arrays(F.array(*map(F.lit, _JUDGED)), F.array(*[F.col(f"_s_{f}") for f in _JUDGED]))
    return entries if only is None else F.map_filter(entries, lambda k, _: F.coalesce(F.map_contains_key(only, k), F.lit(False)))


def prepared(commands: DataFrame, records: DataFrame, tasks: DataFrame, files: DataFrame) -> DataFrame:
    """commands with all that the batch itself says about them, one row each."""
    stated = field_states(commands, lambda f: F.try_element_at("fields", F.lit(f)))
    names = F.coalesce(F.map_keys("fields"), F.array().cast("array<string>"))
    unfit = (F.size(F.array_except(names, F.array(*map(F.lit, FIELDS)))) > 0) | F.exists(F.coalesce(F.map_values("fields"), F.array().cast("array<string>")), lambda v: F.coalesce(F.length(v) > LONGEST_TEXT, F.lit(False)))
    asked = stated.select(*commands.columns, _states(F.col("fields")).alias("states"), F.coalesce(unfit, F.lit(False)).alias("unfit"))
    digest = F.sha2(F.to_json(F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if c == "fields" else F.col(c) for c in _PAYLOAD])), 256)
    asked = asked.withColumns({"digest": digest, "manual_id": F.concat(F.lit("manual-"), F.sha2(F.concat_ws("\n", "workspace_id", "request_id"), 256))})
    own = ["workspace_id", "record_id"]
    based = field_states(records, F.col).select(*own, F.struct("file_id", "page").alias("record_page"), (F.col("parse_status") != "ready").alias("record_open"), _states().alias("record_states"))
    on_page = records.groupBy("workspace_id", "file_id", "page").agg(F.count("*").alias("page_rows"), F.count_if(F.col("parse_status") != "ready").alias("page_open")).select("workspace_id", F.struct("file_id", "page").alias("task_page"), "page_rows", "page_open")
    asked = asked.join(based, own, "left")
    named = tasks.select("workspace_id", "review_id", F.struct("file_id", "page").alias("task_page"))
    on_task = named.join(on_page, (on_page["workspace_id"] == named["workspace_id"]) & on_page["task_page"].eqNullSafe(named["task_page"]), "left").select(named["workspace_id"], "review_id", named["task_page"], "page_rows", "page_open")
    asked = asked.join(on_task, ["workspace_id", "review_id"], "left")
    return asked.join(files.select("workspace_id", "file_id", "needs_page", "n_pages", F.lit(True).alias("file_known")), ["workspace_id", "file_id"], "left")


class Workspace:
    """The state of a workspace after the commands so far, and how to go back."""

    def __init__(self) -> None:
        self.revision = 0
        self.requests: dict[str, tuple[str, int]] = {}  # applied ones: payload, revision
        self.stack: list[tuple[int, list]] = []  # revisions that an undo can take back, with what they replaced
        #: record: states that a person's values have; record: excluded; record added: its page; task: its page
        self.stores: dict[str, dict] = {"override": {}, "excluded": {}, "manual": {}, "resolved": {}}
        self.touched: dict[tuple, set[str]] = {}  # page: records of commands
        self.open: dict[str, bool] = {}  # touched record of the batch: whether it needed review

    def put(self, log: list, store: str, key, value) -> None:
        held = self.stores[store]
        log.append((store, key, held.get(key)))
        if value is None:
            held.pop(key, None)
        else:
            held[key] = value

    def reopen(self, log: list, page: tuple) -> None:
        for task in [t for t, p in self.stores["resolved"].items() if p == page]:
            self.put(log, "resolved", task, None)

    def change(self, c: dict) -> tuple[str, list]:
        """What becomes of a command at its own revision, and what it replaced."""
        log: list = []
        action, key, said, stores = c["action"], c["record_id"], dict(c["states"] or ()), self.stores
        if action in ("confirm", "exclude"):
            page = stores["manual"].get(key) or (tuple(c["record_page"].values()) if c["record_page"] else None)
            if page is None:
                return "record_unknown", log
            if action == "confirm":
                states = {**dict(c["record_states"] or ()), **stores["override"].get(key, {}), **said}
                if c["unfit"] or not confirmable(states):
                    return "fields_invalid", log
                self.put(log, "override", key, states)
                self.put(log, "excluded", key, None)
            else:
                self.put(log, "excluded", key, True)
            self.touched.setdefault(page, set()).add(key)
            if c["record_page"]:
                self.open[key] = c["record_open"]
            self.reopen(log, page)
            return "applied", log
        if action == "add":
            number = c["page"]
            if not c["file_known"]:
                return "file_unknown", log
            if number is None and c["needs_page"] or number is not None and not 1 <= number <= min(MOST_PAGES, c["n_pages"] or MOST_PAGES):
                return "page_invalid", log
            if c["unfit"] or not confirmable(said):
                return "fields_invalid", log
            page = (c["file_id"], number)
            self.put(log, "manual", c["manual_id"], page)
            self.put(log, "override", c["manual_id"], said)
            self.touched.setdefault(page, set()).add(c["manual_id"])
            self.reopen(log, page)
            return "applied", log
        if action == "resolve_page":
            if c["task_page"] is None:
                return "page_unknown", log
            page = tuple(c["task_page"].values())
            touched, gone, named = self.touched.get(page, ()), stores["excluded"], stores["override"]
            settled = sum(self.open.get(k, False) and (k in gone or k in named) for k in touched)
            if (c["page_open"] or 0) > settled:
                return "page_pending", log
            rows = (c["page_rows"] or 0) - sum(k in gone and k in self.open for k in touched) + sum(k in stores["manual"] and k not in gone for k in touched)
            if c["observed_count"] != rows:
                return "count_mismatch", log
            self.put(log, "resolved", c["review_id"], page)
            return "applied", log
        return "action_unknown", log

    def take(self, c: dict) -> tuple[str, int | None]:
        """(outcome, revision that the request has made)."""
        if not c["request_ok"]:
            return "request_invalid", None
        if not c["note_ok"]:
            return "note_missing", None
        if known := self.requests.get(c["request_id"]):
            return ("replayed", known[1]) if known[0] == c["digest"] else ("request_reused", None)
        if c["expected_revision"] != self.revision:
            return "stale", None
        if c["action"] == "undo":
            if not self.stack or self.stack[-1][0] != c["target_revision"]:
                return "undo_not_newest", None
            for store, key, value in reversed(self.stack.pop()[1]):
                self.put([], store, key, value)
        else:
            outcome, log = self.change(c)
            if outcome != "applied":
                return outcome, None
            self.stack.append((self.revision + 1, log))
        self.revision += 1
        self.requests[c["request_id"]] = c["digest"], self.revision
        return "applied", self.revision


def confirmable(states: dict[str, str]) -> bool:
    """Whether a record with fields in these states may stand as a person's: a date, an amount, a direction and
    a currency that can be read, and nothing that cannot."""
    dated = "ok" in (states.get("transaction_at"), states.get("booking_at"))
    return dated and "bad" not in states.values() and all(states.get(f) == "ok" for f in ("amount", "direction", "currency"))


def replay_commands(commands: DataFrame, records: DataFrame, tasks: DataFrame, files: DataFrame) -> DataFrame:
    """commands with outcome and revision (null unless the request is applied, then or before), and manual_id.

    commands: COMMAND, seq being the order of arrival within a workspace (unique there). records: (workspace_id,
    record_id, file_id, page, parse_status and the judged fields as text); tasks: (workspace_id, review_id,
    file_id, page) of the pages under review; files: (workspace_id, file_id, needs_page, n_pages). Keys of these
    three are unique.

    Outcomes: applied, replayed, request_invalid, request_reused (another command under that id), note_missing
    (every action but confirm needs a note), stale, undo_not_newest, record_unknown, fields_invalid, file_unknown,
    page_invalid, page_unknown, page_pending (records on it are open), count_mismatch, action_unknown.
    """
    ship(commands.sparkSession)
    ready = prepared(commands, records, tasks, files).withColumns(
        {
            "request_ok": F.coalesce(F.col("request_id").rlike(REQUEST), F.lit(False)),
            "note_ok": (F.length(F.coalesce("note", F.lit(""))) <= LONGEST_TEXT) & ((F.col("action").eqNullSafe("confirm")) | (F.trim(F.coalesce("note", F.lit(""))) != "")),
        }
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, book = None, Workspace()
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                if c["workspace_id"] != name:
                    name, book = c["workspace_id"], Workspace()
                out.append((name, c["seq"], *book.take(c)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["workspace_id", "seq", "outcome", "revision"])

    ordered = ready.repartition("workspace_id").sortWithinPartitions("workspace_id", "seq")
    taken = ordered.mapInArrow(run, "workspace_id string, seq long, outcome string, revision long")
    manual = F.when((F.col("action") == "add") & (F.col("outcome") == "applied"), F.concat(F.lit("manual-"), F.sha2(F.concat_ws("\n", "workspace_id", "request_id"), 256)))
    return commands.join(taken, ["workspace_id", "seq"]).withColumn("manual_id", manual)


def standing(replayed: DataFrame, revision: int | None = None) -> DataFrame:
    """The applied commands that hold at a revision of each workspace (default: its newest): neither an undo nor
    taken back by then."""
    applied = replayed.where("outcome = 'applied'")
    if revision is not None:
        applied = applied.where(F.col("revision") <= revision)
    undone = applied.where("action = 'undo'").select("workspace_id", F.col("target_revision").alias("revision"))
    return applied.where("action <> 'undo'").join(undone, ["workspace_id", "revision"], "left_anti")


def record_states(replayed: DataFrame, revision: int | None = None) -> DataFrame:
    """(workspace_id, record_id, excluded, fields map, confirmed, manual): each record that standing commands touch.

    fields: what a person stated, a later confirmation over an earlier one; null if the record was only excluded.
    """
    held = standing(replayed, revision).where("action IN ('confirm', 'exclude', 'add')").withColumn("record_id", F.coalesce("manual_id", "record_id"))
    newest = F.max_by(F.struct("action"), "revision")
    stated = F.array_sort(F.collect_list(F.when(F.col("action") != "exclude", F.struct("revision", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields")))), lambda a, b: (a["revision"] - b["revision"]).cast("int"))
    merged = F.aggregate("_stated", F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(x["fields"], k)), x["fields"]))
    grouped = held.groupBy("workspace_id", "record_id").agg((newest["action"] == "exclude").alias("excluded"), stated.alias("_stated"), F.bool_or(F.col("action") == "add").alias("manual"))
    return grouped.select("workspace_id", "record_id", "excluded", F.when(F.size("_stated") > 0, merged).alias("fields"), (F.size("_stated") > 0).alias("confirmed"), "manual")


def resolved_pages(replayed: DataFrame, records: DataFrame, tasks: DataFrame, revision: int | None = None) -> DataFrame:
    """(workspace_id, review_id): the pages that stand as counted, no later command having touched them."""
    held = standing(replayed, revision)
    pages = tasks.select("workspace_id", "review_id", F.struct("file_id", "page").alias("_page"))
    counted = held.where("action = 'resolve_page'").groupBy("workspace_id", "review_id").agg(F.max("revision").alias("_at")).join(pages, ["workspace_id", "review_id"])
    added = held.where("action = 'add'").select("workspace_id", F.col("manual_id").alias("record_id"), F.struct("file_id", "page").alias("_page"))
    places = records.select("workspace_id", "record_id", F.struct("file_id", F.col("page").cast("long").alias("page")).alias("_page")).unionByName(added)
    touched = held.where("action IN ('confirm', 'exclude')").select("workspace_id", "record_id", "revision").join(places, ["workspace_id", "record_id"]).select("workspace_id", "_page", "revision")
    touched = touched.unionByName(held.where("action = 'add'").select("workspace_id", F.struct("file_id", "page").alias("_page"), "revision")).groupBy("workspace_id", "_page").agg(F.max("revision").alias("_touched"))
    c, t = counted.alias("c"), touched.alias("t")
    joined = c.join(t, (F.col("c.workspace_id") == F.col("t.workspace_id")) & F.col("c._page").eqNullSafe(F.col("t._page")), "left")
    return joined.where("_touched IS NULL OR _touched < _at").select("c.workspace_id", "review_id")


def undo_revision(replayed: DataFrame) -> DataFrame:
    """(workspace_id, undo_revision): what an undo would take back now."""
    return standing(replayed).groupBy("workspace_id").agg(F.max("revision").alias("undo_revision"))
