"""Property tests: generated histories against a brute-force LAG."""

from frames import BASE, client, presence, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from test_sequence import brute

from rollcall.operators import sequence

P = 30

# a history: per user, a list of (gap in polls, extra seconds, copies in the poll, channel)
step = st.tuples(st.integers(0, 4), st.sampled_from([0, 0, 1]), st.integers(1, 3), st.integers(1, 3))
history = st.dictionaries(st.sampled_from(["a", "b", "c"]), st.lists(step, min_size=1, max_size=25),
                          min_size=1, max_size=3)


def build(hist):
    rs, i = [], 0
    for uid, steps in sorted(hist.items()):
        t = BASE
        for gap, extra, copies, ch in steps:
            t += gap * P + extra
            for c in range(copies):
                i += 1
                rs.append(client(i, t, uid=uid, channel=(ch + c) % 3 + 1))
    return rs


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hist=history, slice_polls=st.integers(1, 6))
def test_sequences_match_brute_force(spark, hist, slice_polls):
    rs = build(hist)
    pr = presence(spark, rs, p=P)
    want = brute(rs, P)
    got = {r["client_uid"]: (r["total_samples"], r["session_count"], r["channel_switches"])
           for r in rows(sequence.sequence_metrics(pr.clients, P, slice_polls))}
    assert got == {u: (v["n"], v["sessions"], v["switches"]) for u, v in want.items()}
    ses = sorted((r["client_uid"], r["session_no"], r["session_start"], r["session_end"], r["samples"])
                 for r in rows(sequence.sessions(pr, None, slice_polls)))
    assert ses == sorted(x for v in want.values() for x in v["rows"])


flag_values = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([1.0, 0.5, 2.0]),
                        st.sampled_from(["1", "0", "1.0", " 1 ", "true", "TRUE", "false", "yes", "", "01"]))


def expected_flag(v):
    """The rule: set exactly when the value equals the number 1 (JSON true equals 1)."""
    if v is None:
        return False
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return v == 1
    text = v.strip().lower()
    if text == "true":
        return True
    try:
        return float(text) == 1.0
    except ValueError:
        return False


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(flag_values, min_size=1, max_size=12))
def test_payload_flags_follow_the_rule(spark, values):
    import json

    from rollcall.sources import payloads

    body = [{"clid": i, "client_unique_identifier": f"u{i}", "client_away": v} for i, v in enumerate(values)]
    texts = spark.createDataFrame([(BASE, json.dumps({"status": {"code": 0}, "body": body}))],
                                  "poll_ts long, payload string")
    _, cs = payloads.ingest_client_payloads(texts)
    got = {r["client_uid"]: r["is_away"] for r in cs.collect()}
    assert got == {f"u{i}": expected_flag(v) for i, v in enumerate(values)}
