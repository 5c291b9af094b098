import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from puckline.operators import boxscore as bx
from puckline.operators import maintenance as mt
from puckline.operators import pbp as pb
from puckline.operators import schedule as sc
from puckline.operators import views as vw
from puckline.sources import landing as ld
from puckline.sources import proxies as px
from puckline.sources import storage as st
from puckline.streaming import landing_stream as ls

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_twice_equals_once(spark):
    sched = sc.with_days_rest(px.schedule(spark, SF))
    box = bx.dedupe_boxscores(px.box(spark, SF), px.BOX_SOURCE_COLUMNS).drop(*px.BOX_SOURCE_COLUMNS)
    existing = bx.combine_boxscores(box, None, sched)
    ids = px.schedule(spark, SF).filter(F.col("date").between("1998-01-01", "1998-03-01")).select("game_id")
    incoming = bx.combine_boxscores(box.join(ids, "game_id", "left_semi"), pb.player_game_stats(px.pbp(spark, SF)), sched)
    once = mt.upsert_games(existing, incoming)
    twice = mt.upsert_games(once, incoming)
    assert rows(once) == rows(twice)
    assert once.count() == existing.count()


def test_backfill_merge_refetch_counts_once_and_keeps_old_events(spark):
    sched = sc.with_days_rest(px.schedule(spark, SF))
    box = bx.dedupe_boxscores(px.box(spark, SF), px.BOX_SOURCE_COLUMNS).drop(*px.BOX_SOURCE_COLUMNS)
    ev = px.pbp(spark, SF)
    full = bx.combine_boxscores(box, pb.player_game_stats(ev), sched)
    # the same games landed twice (D4) -> counted once
    twice = mt.backfill_merge(box, box, ev, ev, sched)
    assert rows(twice) == rows(full)
    # no new play-by-play (D5): stored events still produce the stats
    empty_ev = ev.limit(0)
    kept = mt.backfill_merge(box, box.limit(0), ev, empty_ev, sched)
    assert rows(kept) == rows(full)


def test_plan_shapes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "pbp")
    px.pbp(spark, SF).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = pb.player_game_stats(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert plan.count("Exchange hashpartitioning(game_id#") >= 1
    assert plan.count("Exchange hashpartitioning(game_id") <= 3
    top = vw.top_n_games(px.facts(spark, SF), 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
        rest = sc.with_days_rest(spark.read.parquet(path).select("game_id").limit(0).join(
            px.schedule(spark, SF), "game_id", "right"))
        p = rest._jdf.queryExecution().executedPlan().toString()
        # the only window runs over the per (season, team, day) aggregate
        assert p.count("Window [") == 1 and "lag(_day" in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_archive_and_replace(spark, tmp_dir):
    s = sc.with_days_rest(px.schedule(spark, SF))
    st.write_seasons(s, f"{tmp_dir}/t")
    new = s.filter(F.col("season") == 19961997).withColumn("home_score", F.lit(9).cast("bigint"))
    archived = st.archive_and_replace(new, f"{tmp_dir}/t", f"{tmp_dir}/a", f"{tmp_dir}/s", "x1")
    assert archived.count() == s.filter(F.col("season") == 19961997).count()
    after = st.scan_all_seasons(spark, f"{tmp_dir}/t")
    assert after.count() == s.count()
    assert after.filter("season = 19961997 AND home_score <> 9").count() == 0
    assert after.filter("season <> 19961997 AND home_score = 9").count() == 0


def test_stream_ingest_is_incremental_and_idempotent(spark, tmp_dir):
    landing = f"{tmp_dir}/landing"
    seasons = px.schedule(spark, SF).select("game_id", "season")
    docs = ld.landed_pbp(spark, SF).join(seasons, "game_id")
    first, second = docs.filter(F.col("game_id") < 12), docs.filter(F.col("game_id") >= 8)
    ls.land(first, landing, "pbp")
    table, ckpt = f"{tmp_dir}/raw_pbp", f"{tmp_dir}/ckpt"
    ls.ingest(spark, landing, "pbp", table, ckpt)
    ls.land(second, landing, "pbp")          # overlaps games 8-11: must not double count
    ls.ingest(spark, landing, "pbp", table, ckpt)
    ls.ingest(spark, landing, "pbp", table, ckpt)  # nothing new
    got = st.scan_all_seasons(spark, table).drop("season")
    want = ld.flatten_pbp(ld.landed_pbp(spark, SF))
    assert rows(got.select(*want.columns)) == rows(want)


def test_jobs_backfill_then_refresh(spark, tmp_dir):
    from puckline.plans import jobs
    out = f"{tmp_dir}/wh"
    seasons = px.schedule(spark, SF).select("game_id", "season")
    box_docs = ld.landed_boxscores(spark, SF).join(seasons, "game_id")
    pbp_docs = ld.landed_pbp(spark, SF).join(seasons, "game_id")
    team_sched = ld.landed_team_schedules(spark, SF)
    # a job's result reads files the next job replaces: collect before moving on
    a = rows(jobs.backfill(spark, team_sched, box_docs, pbp_docs, out, as_of="2001-12-31"))
    b = rows(jobs.backfill(spark, team_sched, box_docs, pbp_docs, out, as_of="2001-12-31"))
    assert a == b and len(a) > 0
    r = rows(jobs.refresh(spark, ld.landed_scores(spark, SF), box_docs, pbp_docs, out, "1999-03-15", 30))
    assert r == b


def _warehouse(spark, out, keep=None, **options):
    """Backfill of the proxies (or of the games that ``keep`` selects)."""
    from puckline.plans import jobs
    seasons = px.schedule(spark, SF).select("game_id", "season")
    box_docs = ld.landed_boxscores(spark, SF).join(seasons, "game_id")
    pbp_docs = ld.landed_pbp(spark, SF).join(seasons, "game_id")
    sched = ld.landed_team_schedules(spark, SF)
    if keep is not None:
        box_docs, pbp_docs = box_docs.filter(keep), pbp_docs.filter(keep)
        sched = sched.filter(F.get_json_object("doc", "$.games[0].id").cast("bigint") % 2 == 0)
    jobs.backfill(spark, sched, box_docs, pbp_docs, out, **{"as_of": "2001-12-31"} | options)
    return sched, box_docs, pbp_docs


def _tables(spark, out):
    from puckline import schemas
    return {t: rows(st.scan_all_seasons(spark, f"{out}/{t}", schema=s)) for t, s in schemas.TABLES.items() if t != "roster"}


def test_partial_second_landing_loses_nothing(spark, tmp_dir):
    out = f"{tmp_dir}/wh"
    _warehouse(spark, out)
    before = _tables(spark, out)
    _warehouse(spark, out, keep=F.col("game_id") % 2 == 0, only_missing=False)
    assert _tables(spark, out) == before
    assert all(before.values())


def test_documents_landed_twice_count_once_and_the_newest_wins(spark, tmp_dir):
    from puckline.plans import jobs
    out = f"{tmp_dir}/wh"
    sched, box_docs, pbp_docs = _warehouse(spark, out)
    before = _tables(spark, out)
    scores = ld.landed_scores(spark, SF)
    twice = pbp_docs.unionByName(pbp_docs)
    assert rows(jobs.refresh(spark, scores.unionByName(scores), box_docs.unionByName(box_docs), twice, out,
                             "1999-03-15", 400)) == before["comprehensive_boxscores"]
    assert _tables(spark, out) == before
    # The same game again, with a later copy that has another name in it.
    stamped = box_docs.withColumn("landed_at", F.lit("2024-01-01").cast("timestamp"))
    later = (stamped.withColumn("doc", F.replace("doc", F.lit('"default":"P'), F.lit('"default":"Q')))
             .withColumn("landed_at", F.lit("2024-01-02").cast("timestamp")))
    jobs.refresh(spark, scores, later.unionByName(stamped), pbp_docs, out, "1999-03-15", 400)
    ids = {r.game_id for r in sc.recent_games(ld.flatten_scores(scores), "1999-03-15", 400).collect()}
    names = {(r[0] in ids, r[2][0]) for r in _tables(spark, out)["essential_boxscores"]}
    assert (True, "Q") in names and (True, "P") not in names and (False, "P") in names


def test_refresh_updates_scores_and_backfill_keeps_them(spark, tmp_dir):
    from puckline.plans import jobs
    out = f"{tmp_dir}/wh"
    sched, box_docs, pbp_docs = _warehouse(spark, out)
    scores = ld.landed_scores(spark, SF).withColumn(
        "doc", F.regexp_replace("doc", '"score":[0-9]+', '"score":9'))
    jobs.refresh(spark, scores, box_docs, pbp_docs, out, "1999-03-15", 400)
    ids = {r.game_id for r in sc.filter_game_types(sc.recent_games(
        ld.flatten_scores(scores), "1999-03-15", 400)).collect()}
    stored = st.scan_all_seasons(spark, f"{out}/schedule").collect()
    assert ids and all((r.home_score == 9) == (r.game_id in ids) for r in stored)
    assert all(r.start_time for r in stored)  # the feed has none: kept
    after = _tables(spark, out)
    _warehouse(spark, out)
    assert _tables(spark, out) == after  # the schedule, with its scores, too


def test_nothing_played_yet_gives_readable_empty_tables(spark, tmp_dir):
    out = f"{tmp_dir}/wh"
    _warehouse(spark, out, as_of="1900-01-01")
    tables = _tables(spark, out)
    assert tables["schedule"] and not tables["essential_boxscores"] and not tables["comprehensive_boxscores"]
    assert dict(st.scan_all_seasons(spark, f"{out}/schedule").dtypes)["season"] == "bigint"
    _warehouse(spark, out)
    assert all(_tables(spark, out).values())


def test_sample_rosters_and_quarantine(spark, tmp_dir):
    from puckline.plans import jobs
    out = f"{tmp_dir}/wh"
    bad = spark.createDataFrame([(99, 19961997, "{not json"), (98, 19961997, None)], "game_id bigint, season bigint, doc string")
    seasons = px.schedule(spark, SF).select("game_id", "season")
    box_docs = ld.landed_boxscores(spark, SF).join(seasons, "game_id")
    jobs.backfill(spark, ld.landed_team_schedules(spark, SF), box_docs.unionByName(bad),
                  ld.landed_pbp(spark, SF).join(seasons, "game_id"), out, as_of="2001-12-31", sample=3,
                  rosters=ld.landed_rosters(spark, SF), roster_season=19971998)
    assert st.scan_all_seasons(spark, f"{out}/essential_boxscores").select("game_id").distinct().count() <= 3
    assert sorted(r.game_id for r in spark.read.parquet(f"{out}/quarantine/boxscore").collect()) == [98, 99]
    roster = st.scan_all_seasons(spark, f"{out}/roster")
    assert roster.count() == px.roster(spark, SF).count() and roster.first().season == 19971998
    assert jobs.current_roster(spark, out).count() == roster.count()


def _sched(spark, landed):
    schema = ("game_id long, date string, season long, game_type long, away_abbrev string, away_score long, home_abbrev string, "
              "home_score long, start_time string, venue string, landed_at string")
    return spark.createDataFrame(landed, schema).withColumn("landed_at", F.col("landed_at").cast("timestamp"))


def test_schedule_fields_take_their_last_writer(spark):
    from puckline import schemas
    empty = spark.createDataFrame([], schemas.SCHEDULE_MERGED)

    def one(stored, *landed):
        out = mt.merge_schedule(stored, _sched(spark, list(landed)))
        return out, out.collect()[0]

    base = (1, "2024-01-05", 20232024, 2, "A", None, "B", None, "19:00", "V", "2024-01-01")
    stored, r = one(empty, base)
    assert (r.home_score, r.venue, r.score_at) == (None, "V", None)
    stored, r = one(stored, (1, "2024-01-05", 20232024, 2, "A", 2, "B", 3, None, None, "2024-01-06"))
    assert (r.away_score, r.home_score, r.start_time, r.venue) == (2, 3, "19:00", "V")
    # An older document, one of unknown age, and one that knows no score leave the score alone.
    for late in ((0, 0, "2024-01-02"), (0, 0, None), (None, None, "2024-01-07")):
        stored, r = one(stored, (1, "2024-01-05", 20232024, 2, "A", late[0], "B", late[1], "20:00", None, late[2]))
        assert (r.away_score, r.home_score) == (2, 3)
    assert r.start_time == "20:00"
    stored, r = one(stored, (1, "2024-02-05", 20232024, 2, "A", 4, "B", 5, None, "W", "2024-01-08"),
                    (1, "2024-01-05", 20232024, 2, "A", 9, "B", 9, None, "X", "2024-01-03"))
    assert (r.date, r.away_score, r.home_score, r.venue) == ("2024-02-05", 4, 5, "W")


def test_one_team_roster_lands(spark, tmp_dir):
    from puckline.plans import jobs
    out = f"{tmp_dir}/wh"
    schema = "team_abbrev string, doc string, landed_at string"

    def doc(names):
        return json.dumps({"forwards": [{"id": i, "firstName": {"default": n}, "lastName": {"default": "Man"}, "positionCode": "C"}
                                        for i, n in names.items()]})

    def landed(*rows_of):
        return spark.createDataFrame(list(rows_of), schema).withColumn("landed_at", F.col("landed_at").cast("timestamp"))

    first = {"A": {1: "a", 2: "b", 3: "c"}, "B": {4: "d", 5: "e"}, "C": {6: "f"}}
    jobs.write_rosters(spark, landed(*[(t, doc(x), "2024-01-01") for t, x in first.items()]), out, 20232024)
    before = {(r.team_abbrev, r.player_id): r for r in jobs.current_roster(spark, out).collect()}
    assert set(before) == {(t, i) for t, x in first.items() for i in x}
    team, gone, mine = "A", 1, [1, 2, 3]
    second = landed(("A", doc({2: "Other", 3: "c", 777: "New"}), "2024-02-01"), ("A", "{", "2024-03-01"), ("A", doc({}), "2023-01-01"),
                    ("B", doc({}), "2023-01-01"))
    for _ in range(2):  # a rerun changes nothing
        jobs.write_rosters(spark, second, out, 20232024)
        after = {(r.team_abbrev, r.player_id): r for r in jobs.current_roster(spark, out).collect()}
        assert {k for k in before if k[0] != team} == {k for k in after if k[0] != team}
        assert {p for t, p in after if t == team} == {777, *mine} - {gone}
        assert (after[team, 2].full_player_name, after[team, 3].full_player_name) == ("Other Man", "c Man")
    stays = jobs.roster_history(spark, out)
    assert {(r.team_abbrev, r.player_id) for r in mt.roster_asof(stays, "2024-01-15").collect()} == set(before)
    assert {(r.team_abbrev, r.player_id) for r in mt.roster_asof(stays, "2024-02-15").collect()} == set(after)
    assert mt.roster_asof(stays, "2023-12-31").count() == 0
    stored = st.scan_all_seasons(spark, f"{out}/roster")
    assert {r.team_abbrev for r in stored.collect()} >= {"A", "C"}
    assert [r.doc for r in spark.read.parquet(f"{out}/quarantine/rosters").collect()] == ["{"]
    # Requests see the roster of their day.
    from puckline.operators import props as pr
    g = spark.createDataFrame([(1, "2024-01-15", team, "ZZZ"), (2, "2024-02-15", team, "ZZZ")],
                              "game_id long, date string, home_abbrev string, away_abbrev string")
    listed = pr.eligible_players(pr.requests_for_games(g, [("Skater", "shots", 1.5), ("Goalie", "saves", 1.5)]),
                                 px.facts(spark, SF).limit(0), stays, "2000-01-01").collect()
    assert {r.player_id for r in listed if r.matchup_id == 1} == set(mine)
    assert {r.player_id for r in listed if r.matchup_id == 2} == {777, *mine} - {gone}


def test_quarantine_collects(spark, tmp_dir):
    from puckline.plans import jobs
    out = f"{tmp_dir}/wh"
    schema = "game_id bigint, season bigint, doc string"
    sched, box_docs, pbp_docs = _warehouse(spark, out)
    first = spark.createDataFrame([(99, 1, "{not json"), (98, 1, None)], schema)
    second = spark.createDataFrame([(99, 1, "{not json"), (97, 1, "[")], schema)
    for bad in (first, second, second):
        jobs.refresh(spark, ld.landed_scores(spark, SF), box_docs.unionByName(bad), pbp_docs, out, "1999-03-15", 30)
    assert sorted(r.game_id for r in spark.read.parquet(f"{out}/quarantine/boxscore").collect()) == [97, 98, 99]


def test_killed_write_leaves_the_old_tables(spark, tmp_dir, monkeypatch):
    import pytest

    from puckline.plans import jobs
    from puckline.sources import snapshots
    out = f"{tmp_dir}/wh"
    sched, box_docs, pbp_docs = _warehouse(spark, out)
    before = _tables(spark, out)
    old = jobs.read_table(spark, out, "essential_boxscores")  # a reader that has resolved its version
    later = box_docs.withColumn("doc", F.replace("doc", F.lit('"default":"P'), F.lit('"default":"Q')))

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(snapshots, "_publish", dies)
    with pytest.raises(RuntimeError, match="killed"):
        _warehouse(spark, out, only_missing=False)
    table = f"{out}/essential_boxscores"
    with pytest.raises(RuntimeError, match="killed"):
        snapshots.commit(spark, table, old.limit(1).withColumn("part", F.lit("x")), ["season", "part"])
    monkeypatch.undo()
    assert _tables(spark, out) == before
    jobs.refresh(spark, ld.landed_scores(spark, SF), later, pbp_docs, out, "1999-03-15", 400)
    assert rows(old) == before["essential_boxscores"] != _tables(spark, out)["essential_boxscores"]
    assert rows(jobs.read_table(spark, out, "essential_boxscores", version=1)) == before["essential_boxscores"]
    after = _tables(spark, out)
    snapshots.expire(spark, table)
    assert snapshots.versions(spark, table) == [2] and _tables(spark, out) == after
    with pytest.raises(Exception, match="exists"):  # two writers of one version
        snapshots._publish(spark, table, 2, {})


def test_refresh_rewrites_only_the_parts_that_hold_its_games(spark, tmp_dir):
    from puckline.plans import jobs
    from puckline.sources import snapshots
    out = f"{tmp_dir}/wh"
    sched, box_docs, pbp_docs = _warehouse(spark, out)
    before = _tables(spark, out)
    feed = ld.landed_scores(spark, SF)
    landed = box_docs.select("game_id").distinct()
    day = sc.filter_game_types(ld.flatten_scores(feed)).join(landed, "game_id").agg(F.date_add(F.to_date(F.max("date")), 1)).first()[0]
    jobs.refresh(spark, feed, box_docs, pbp_docs, out, day, 7)
    recent = sc.filter_game_types(sc.recent_games(ld.flatten_scores(feed), day, 7)).join(landed, "game_id")
    parts = {f"season={r.season}/part={r.date[:7]}" for r in recent.collect()}
    for table in ("essential_boxscores", "raw_pbp_events", "comprehensive_boxscores", "games"):
        path = f"{out}/{table}"
        assert snapshots.changed(spark, path, 1, 2) == parts & set(snapshots.manifest(spark, path))
        assert len(parts) < len(snapshots.manifest(spark, path)) / 4
    assert _tables(spark, out) == before


def test_moved_game_changes_its_part_and_the_rest_days(spark, tmp_dir):
    from puckline.plans import jobs
    from puckline.sources import snapshots
    out = f"{tmp_dir}/wh"
    sched, box_docs, pbp_docs = _warehouse(spark, out)
    combined = jobs.read_table(spark, out, "comprehensive_boxscores")
    r = combined.join(jobs.read_table(spark, out, "schedule").select("game_id", "season"), "game_id").filter("date like '%-03-%'").first()
    month = f"{r.date[:4]}-05"
    moved = sched.withColumn("doc", F.when(F.get_json_object("doc", "$.games[0].id") == str(r.game_id),
                                           F.replace("doc", F.lit(r.date), F.lit(f"{month}-20"))).otherwise(F.col("doc")))
    jobs.backfill(spark, moved, box_docs.limit(0), pbp_docs.limit(0), out, as_of="2001-12-31")
    fresh = f"{tmp_dir}/fresh"
    jobs.backfill(spark, moved, box_docs, pbp_docs, fresh, as_of="2001-12-31")
    assert _tables(spark, out) == _tables(spark, fresh)
    where = snapshots.read(spark, f"{out}/essential_boxscores", T.StructType.fromDDL("game_id long, season long, part string"))
    assert {x.part for x in where.filter(F.col("game_id") == r.game_id).collect()} == {month}


def test_missing_games_come_from_the_ledger(spark, tmp_dir):
    from puckline import schemas
    from puckline.operators import quality as qa
    from puckline.plans import jobs
    from puckline.sources import snapshots
    out = f"{tmp_dir}/wh"
    _warehouse(spark, out, keep=F.col("game_id") % 2 == 0, only_missing=False)
    ledger = snapshots.read(spark, f"{out}/games", schemas.GAME_LEDGER, ("part",))
    schedule = px.schedule(spark, SF)
    got = qa.missing_in_ledger(schedule, ledger, "2001-12-31")
    box, pbp = (jobs.read_table(spark, out, t) for t in ("essential_boxscores", "raw_pbp_events"))
    assert rows(got) == rows(qa.missing_games(schedule, pbp, box, "2001-12-31").select(*got.columns)) != []
    plan = qa.missing_in_ledger(schedule, ledger, "2001-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "event" not in plan and plan.count("FileScan parquet") == 2


def test_names_are_found_through_their_grams(spark, tmp_dir):
    from puckline.operators import quality as qa
    from puckline.plans import jobs
    names = ["Ann Lee", "ann lee", "Lee Ann", "Élan", "a.b", "axb", "aaaa", "", "x", None, "İx"]
    box = spark.createDataFrame([(i % 7, n) for i, n in enumerate(names)] * 2, "player_id long, player_name string")
    postings = qa.name_postings(box)
    for text in ("", "a", "ee", "lee", "nn l", "a.b", ".", "aaa", "aaaaa", "ÉLAN", "zz", "%", "Lee A"):
        assert rows(qa.search_names(postings, text)) == rows(qa.player_search(box, text)), text
    out = f"{tmp_dir}/wh"
    _warehouse(spark, out)
    stored = jobs.read_table(spark, out, "essential_boxscores")
    for text in ("p0", "P3", "p17", ""):
        assert rows(jobs.search_players(spark, out, text)) == rows(qa.player_search(stored, text))
    plan = jobs.search_players(spark, out, "p17")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "boxscores" not in plan and "In(gram" in plan.replace("EqualTo(gram", "In(gram")


def test_landing_folder(spark, tmp_dir):
    """Files of one document each, named by their envelope, through backfill and refresh."""
    import os

    from puckline.plans import jobs
    folder, out, flat = f"{tmp_dir}/landing", f"{tmp_dir}/wh", f"{tmp_dir}/flat"
    season = 19961997
    games = px.schedule(spark, SF).filter(F.col("season") == season).select("game_id", "season")
    docs = {"boxscores": ld.landed_boxscores(spark, SF).join(games, "game_id"), "pbp": ld.landed_pbp(spark, SF).join(games, "game_id"),
            "rosters": ld.landed_rosters(spark, SF).withColumn("season", F.lit(season))}
    team_docs = ld.landed_team_schedules(spark, SF).filter(F.col("season") == season)
    whole = team_docs.groupBy("season", "team").agg(F.concat(F.lit('{"games": ['), F.array_join(F.collect_list(
        F.regexp_extract("doc", r'^\{"games":\[(.*)\]\}$', 1)), ","), F.lit("]}")).alias("doc"))
    days = ld.landed_scores(spark, SF).join(px.schedule(spark, SF).select("date", "season").distinct(), "date").filter(F.col("season") == season)
    scores = days.groupBy("season", "date").agg(F.concat(F.lit('{"games": ['), F.array_join(F.collect_list(
        F.regexp_extract("doc", r'^\{"games":\[(.*)\]\}$', 1)), ","), F.lit("]}")).alias("doc"))
    for kind, rows_of in {**docs, "schedule": whole, "scores": scores}.items():
        name = ld.ENVELOPES[kind][1]
        os.makedirs(f"{folder}/{kind}/{season}")
        for r in rows_of.collect():
            with open(f"{folder}/{kind}/{season}/{r[name]}.json", "w") as f:
                f.write(r.doc)
    with open(f"{folder}/boxscores/{season}/999999999.json", "w") as f:
        f.write("{broken")
    got = rows(jobs.backfill_landing(spark, folder, out, [season, 20992100], as_of="2001-12-31"))
    want = rows(jobs.backfill(spark, team_docs, docs["boxscores"], docs["pbp"], flat, as_of="2001-12-31"))
    assert got == want and got
    assert [r.game_id for r in spark.read.parquet(f"{out}/quarantine/boxscore").collect()] == [999999999]
    assert jobs.current_roster(spark, out).count() == px.roster(spark, SF).count()
    day = px.schedule(spark, SF).filter(F.col("season") == season).agg(F.date_add(F.to_date(F.max("date")), 1)).first()[0]
    assert rows(jobs.refresh_landing(spark, folder, out, [season], day, 60)) == got


def test_plays_without_ids_stay_apart(spark):
    doc = '{"plays": [{"typeDescKey": "hit"}, {"typeDescKey": "hit"}, {"eventId": 0, "typeDescKey": "goal"}]}'
    got = ld.flatten_pbp(spark.createDataFrame([(1, doc)], "game_id bigint, doc string")).collect()
    assert sorted(r.event_id for r in got) == [-2, -1, 0]


def test_facts_without_schedule_or_rest(spark):
    from puckline.operators import facts as fc
    sched = sc.with_days_rest(px.schedule(spark, SF))
    box = bx.dedupe_boxscores(px.box(spark, SF), px.BOX_SOURCE_COLUMNS).drop(*px.BOX_SOURCE_COLUMNS)
    combined = bx.combine_boxscores(box, None, sched)
    full = fc.build_facts(combined, px.schedule(spark, SF), None)
    bare = fc.build_facts(combined.drop("days_rest"), None, None)
    assert sorted(bare.columns) == sorted(full.columns)
    assert bare.filter("win <> 0 OR game_type <> 2 OR days_rest <> 99 OR season IS NULL").count() == 0
    same = bare.select("game_id", "player_id", F.col("season").alias("s")).join(full, ["game_id", "player_id"])
    assert same.filter("s <> season").count() == 0


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    import pytest

    from puckline import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(), "x")
