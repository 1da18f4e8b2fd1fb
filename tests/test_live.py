from __future__ import annotations

import packets as P

from wirelake.streaming import live


def run(spark, df, name, files):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for write in files:
            write()
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_windows_sessions_and_connections(spark, tmp_path):
    base = 1_700_000_000_000_000
    one = P.Talk().open().send(0, b"hello", 24).close().frames
    two = P.Talk(("10.0.0.3", 50001)).open().send(0, b"abc", 24).frames
    later = P.Talk(("10.0.0.4", 50002)).send(0, flags=2).frames

    for name in "wsc":
        (tmp_path / name).mkdir()

    def files(folder):
        return [
            lambda: (folder / "a.pcap").write_bytes(P.pcap(one + two, times=[base + i * 1000 for i in range(len(one + two))])),
            lambda: (folder / "b.pcap").write_bytes(P.pcap(later, times=[base + 7_200_000_000])),
            lambda: (folder / "c.pcap").write_bytes(P.pcap(later, times=[base + 14_400_000_000])),
        ]

    frames = live.live_frames(spark, str(tmp_path / "w"))
    got = run(spark, live.window_counts(frames, ["link_type"], "1 minute", late="1 minute"), "w", files(tmp_path / "w"))
    assert sum(r.n for r in got) == len(one + two) + 1 and {r.link_type for r in got} == {1}
    frames = live.live_frames(spark, str(tmp_path / "s"))
    got = run(spark, live.session_counts(frames, ["link_type"], late="1 minute"), "s", files(tmp_path / "s"))
    assert sorted(r.n for r in got) == [1, len(one + two)]
    frames = live.live_frames(spark, str(tmp_path / "c"))
    got = run(spark, live.connection_states(frames, "1 minute"), "c", files(tmp_path / "c"))
    assert {(r.state, r.segments, r.bytes, r.is_complete) for r in got} >= {("time_wait", 8, 5, True), ("established", 4, 3, False)}
