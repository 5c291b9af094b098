"""Steps that must not be done twice: parses of landed documents, the combined table, the upsert's incoming rows."""

import puckline.registry as registry
from puckline.sources import landing as ld

SF = "/root/testdata/sf0.001"


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_boxscore_document_is_parsed_once(spark):
    landed = spark.createDataFrame([(1, '{"homeTeam": {"abbrev": "A"}}'), (2, None), (3, "no json"), (4, (
        '{"homeTeam": {"abbrev": "A"}, "awayTeam": {"abbrev": "B"}, "playerByGameStats": {"awayTeam": {"forwards": [{"playerId": 7}]}}}'))],
        "game_id bigint, doc string")
    rows = ld.flatten_boxscore(landed)
    assert _optimized(rows).count("from_json(") == 1
    assert [(r.game_id, r.player_id, r.team, r.opponent) for r in rows.collect()] == [(4, 7, "B", "A")]


def test_the_season_that_lands_again_is_read_from_the_table(spark, monkeypatch):
    seen = []
    replace = registry.st.archive_and_replace

    def keep(new_rows, *where):
        seen.append(_optimized(new_rows))
        return replace(new_rows, *where)

    monkeypatch.setattr(registry.st, "archive_and_replace", keep)
    got = registry.QUERIES["refresh_archive"](spark, SF)
    assert got.count() > 0 and got.select("season").distinct().count() == 1
    assert len(seen) == 1 and "l_orderkey" not in seen[0]


def test_the_refresh_dedupes_the_rows_of_its_games_only(spark):
    lines = _optimized(registry.QUERIES["refresh_upsert"](spark, SF)).splitlines()
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(lines)}
    dedupes = [i for i, line in enumerate(lines) if "Window [row_number()" in line and "src_line" in line]
    below = [any("LeftSemi" in lines[j] for j in range(i + 1, len(lines)) if all(depth[k] > depth[i] for k in range(i + 1, j + 1))) for i in dedupes]
    assert below.count(False) == 1 and below.count(True) >= 1  # the stored table, and the rows that land
