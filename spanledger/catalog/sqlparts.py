"""Pieces of oracle SQL. The oracles walk the rows one by one, unlike the engine."""

RUN = 1706745600        # 2024-02-01
GT = 1706659200         # 2024-01-31
DAY = 86400
STEP = 3 * DAY
HORIZON = 7 * DAY
WINDOW = 14 * DAY
N = 7
TX = 4
THRESHOLD = 9


def episodes(unit: str = "second") -> str:
    s = f"(epoch_us(date_trunc('{unit}', ts)) // 1000000)::BIGINT"
    return f"""ev AS (
 SELECT user_id AS client, event_id, event_type AS service, {s} AS s,
  CASE WHEN event_id % 97 <> 0 THEN {s} + round(value * 1800)::BIGINT END AS e0, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS kk FROM events),
ep AS (SELECT *, coalesce(e0, {RUN}) AS e,
  CASE WHEN client % 19 = 0 THEN 'Declined for now' WHEN client % 7 = 0 THEN NULL ELSE 'Explicit' END AS consent,
  CASE WHEN event_id % 11 <> 0 THEN 'g' || (client % 3) END AS gender,
  CASE WHEN kk % 10 <> 0 THEN 'r' || (kk % 4) END AS reason,
  CASE WHEN service = 'view' THEN 't' || (kk % 3) END AS kind,
  CASE WHEN service = 'view' THEN value END AS amount,
  CASE WHEN service = 'purchase' THEN value END AS expense,
  CASE WHEN service = 'click' AND kk % 4 = 0 THEN kk::DOUBLE END AS score,
  631152000 + client * 37 * 86400 AS dob FROM ev)"""


def anchors(horizon: int = HORIZON) -> str:
    return f"""anchors AS (SELECT i::INT AS k, ({GT - horizon} - ({N - 1} - i) * {STEP})::BIGINT AS cut
 FROM range({N}) t(i))"""


def walk(stay_rule: str = "TRUE", lo: str = "0", moves: str | None = None) -> str:
    """Fold over a client's intervals in order. ``stay_rule`` decides whether a row adds days; when
    ``moves`` is 'always' the state advances even if it does not."""
    a = f"greatest(r.s, a.e, {lo})"
    add = f"a.tot + r.e // {DAY} - {a} // {DAY} + CASE WHEN {a} // {DAY} <> a.e // {DAY} THEN 1 ELSE 0 END"
    ok = f"({stay_rule.format(a=a)})"
    if moves == "always":
        step = f"struct_pack(s := r.s, e := r.e, tot := CASE WHEN {ok} THEN {add} ELSE a.tot END)"
        accept = "r.s > a.s AND r.e > a.e"
    else:
        step = f"struct_pack(s := r.s, e := r.e, tot := {add})"
        accept = f"r.s > a.s AND r.e > a.e AND {ok}"
    return f"""coalesce(list_reduce(list(struct_pack(s := s, e := e, tot := 0::BIGINT) ORDER BY s, e DESC),
 lambda a, r: CASE WHEN {accept} THEN {step} ELSE a END,
 struct_pack(s := 0::BIGINT, e := 0::BIGINT, tot := 0::BIGINT)).tot, 0)::BIGINT"""


STAY = walk("r.e - {a} >= 900")
PLAIN = walk()


def visits(service: str) -> str:
    """Counted rows of ``service`` among a client's counted rows in order."""
    pick = {"click": "n", "view": "c", "error": "p"}[service]
    return f"""list_reduce(list(struct_pack(v := service, e := e, n := 0::BIGINT, c := 0::BIGINT, p := 0::BIGINT) ORDER BY s, service, e),
 lambda a, r: CASE WHEN a.v = r.v AND a.e = r.e THEN a
  ELSE struct_pack(v := r.v, e := r.e, n := a.n + CASE WHEN r.v = 'click' THEN 1 ELSE 0 END,
   c := a.c + CASE WHEN r.v = 'view' THEN 1 ELSE 0 END, p := a.p + CASE WHEN r.v = 'error' THEN 1 ELSE 0 END) END,
 struct_pack(v := '', e := 0::BIGINT, n := 0::BIGINT, c := 0::BIGINT, p := 0::BIGINT)).{pick}"""


def label_sql(rows: str, key: str, anchor: str) -> str:
    """Label days per key; ``rows`` must hold client, service, s, e and the key columns."""
    lo = f"({anchor} - {WINDOW})"
    fold = walk("(r.s // 86400 >= " + lo + " // 86400 OR r.e // 86400 >= " + lo + " // 86400) AND r.e - {a} >= 900",
                lo=lo, moves="always")
    return f"SELECT {key}, {fold} AS days FROM {rows} GROUP BY {key}"
