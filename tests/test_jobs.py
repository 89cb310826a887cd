"""Whole jobs on the event episodes: preprocess, train, predict, explain, cluster, horizons; the full export."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spanledger.config import ClusterSettings, ExplainSettings, HorizonSettings, TrainSettings
from spanledger.operators import export as X
from spanledger.plans import dataset as D, jobs
from spanledger.sources import sinks
from spanledger.sources.adapters import EVENT_CFG, Tables
from spanledger.sources.readers import EXPORT_COLUMNS

CFG = replace(EVENT_CFG, explain=ExplainSettings(None, 4, 60, 15, 0.5, 3), cluster=ClusterSettings(3, 2, 2, 3),
              train=TrainSettings(train_split=0.7, val_split=0.1, test_split=0.2), horizon=HorizonSettings(0, 1, 1), kfolds=3)


@pytest.fixture(scope="module")
def episodes(spark):
    return Tables(spark, "/root/testdata/sf0.01").raw_episodes()


@pytest.fixture(scope="module")
def stored(spark, episodes, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("static"))
    return jobs.preprocess(episodes, CFG, path, series=False)


def test_static_job_end_to_end(spark, episodes, stored, tmp_path):
    assert stored.features.count() == stored.features.select("ClientID").distinct().count()
    gender = [c for c in stored.encoded.columns if c.startswith("Gender_")]
    assert stored.encoded.select(sum(F.col(c) for c in gender).alias("n")).distinct().collect() == [(1,)]

    trained = jobs.train(stored, CFG, "logreg", regParam=0.1)
    assert {r["metric"] for r in trained.metrics.collect()} == {"precision", "recall", "f1score", "accuracy", "loss", "auc"}
    trained.save(str(tmp_path / "m"))
    again = jobs.Trained.load(spark, str(tmp_path / "m"))

    table, features = jobs.predict(episodes, CFG, stored.meta, again, series=False)
    rows = table.collect()
    assert len(rows) == features.count() and {r["class"] for r in rows} <= set(CFG.class_names)
    assert {r["Gender"] for r in rows} <= {"g0", "g1", "g2"}

    exps = jobs.explain_predictions(features.where("ClientID < 12"), stored.meta, again, jobs.fit_explainer(stored), CFG)
    per = exps.groupBy("ClientID").count().collect()
    assert per and all(r["count"] == 4 for r in per)
    top = jobs.representative_rules(exps.withColumnRenamed("example", "exp_id"), CFG, str(tmp_path / "rules"), "2024-02-01")
    assert top.count() > 0
    jobs.trending_prediction(table, str(tmp_path / "trend"), "2024-02-01")
    jobs.trending_prediction(table, str(tmp_path / "trend"), "2024-02-08")
    assert sinks.read_runs(spark, str(tmp_path / "trend")).count() == 2 * len(rows)

    assigned, centroids = jobs.cluster_clients(stored, CFG, again, max_iter=5)
    assert assigned.count() == stored.features.count()
    assert abs(sum(r["pct"] for r in centroids.collect()) - 100) < 1e-9


@pytest.mark.parametrize("how", ["class_weight", "random_oversample", "smote", "adasyn"])
def test_balancing_strategies(stored, how):
    cfg = replace(CFG, train=replace(CFG.train, imbalance=how))
    assert jobs.train(stored, cfg, "logreg", maxIter=5).metrics.count() == 18


def test_every_round_is_balanced(stored, monkeypatch):
    """The strategy of the settings reaches each training round, with its weight."""
    seen = []
    fit = jobs.models.fit

    def watch(kind, df, columns, label, seed=7, pos_weight=None, **params):
        n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
        seen.append((max(n.values()) - min(n.values()) if len(n) > 1 else None, pos_weight))
        return fit(kind, df, columns, label, seed, pos_weight, **params)

    monkeypatch.setattr(jobs.models, "fit", watch)
    jobs.experiment(stored, replace(CFG, train=replace(CFG.train, imbalance="random_oversample")), "logreg", "cross_validation", maxIter=2)
    assert len(seen) == CFG.kfolds and all(gap in (0, 1, None) for gap, _ in seen)
    seen.clear()
    jobs.experiment(stored, replace(CFG, train=replace(CFG.train, imbalance="class_weight")), "logreg", "cross_validation", maxIter=2)
    assert {w for _, w in seen} == {CFG.train.pos_weight}


def test_settings_that_ask_for_answers_need_them(episodes, tmp_path):
    with pytest.raises(ValueError, match="answers"):
        jobs.preprocess(episodes, replace(CFG, include_answers=True), str(tmp_path / "x"), series=False)


def test_cross_validation_tables(stored):
    folds, summary = jobs.experiment(stored, CFG, "logreg", "cross_validation", maxIter=5)
    assert folds.count() == 3 and summary.count() == 6


def test_series_job_and_scoring_reuse_the_vocabulary(episodes):
    ds = D.series_dataset(episodes, CFG, n_anchors=7)
    assert ds.features.groupBy("ClientID", "Date").count().where("count > 1").count() == 0
    tail = ds.encoded.columns[-len([c for c in ds.encoded.columns if "-Day_" in c]) - 1:-1]
    assert all("-Day_" in c for c in tail) and tail[0].startswith("(-3)")
    now = D.series_dataset(episodes, replace(CFG, horizon_weeks=0), ds.meta, training=False)
    assert [c for c in ds.encoded.columns if c != "GroundTruth"] == now.encoded.columns
    dates = [str(r["Date"]) for r in now.features.select("Date").distinct().collect()]
    assert dates == ["2024-01-31"]


def test_meta_survives_storage(spark, stored, tmp_path):
    stored.meta.save(spark, str(tmp_path / "meta"))
    assert D.FeatureMeta.load(spark, str(tmp_path / "meta")) == stored.meta


def test_horizon_search_has_a_row_per_fold(episodes):
    out = jobs.horizon_search(episodes, CFG, "logreg", series=False, maxIter=3)
    assert {(r["n"], r["fold"]) for r in out.collect()} == {(n, f) for n in (0, 1) for f in (1, 2, 3)}


def small_source(spark):
    def t(ddl, *rows):
        return spark.createDataFrame(list(rows), ddl).select(
            *[F.col(c).cast("timestamp").alias(c) if "Date" in c or c == "DOB" else F.col(c) for c in [x.split()[0] for x in ddl.split(", ")]])

    codes = "ID int, NameE string"
    return {
        "organizations": t("OrganizationID int, Name string, ClusterID int", (1, "House", 16), (2, "Else", 3)),
        "consents": t("ConsentID int, ClientID int, ConsentTypeID int, StartDate string, ExpiryDate string",
                      (1, 1, 1, "2019-01-01", None), (2, 1, 2, "2019-01-01", None), (3, 2, 1, "2019-01-01", "2019-06-01"), (4, 3, 2, "2019-01-01", None)),
        "consent_providers": t("ConsentID int, OrgID int", (1, 1), (2, 1), (3, 1), (4, 1)),
        "consent_types": t(codes, (1, "Explicit"), (2, "Declined")),
        "placements": t("HousePlacementID int, PrimaryClientID int, ServiceID int, DateSearchStarted string, MovedInDate string, PlacementEndedYN string",
                        (1, 1, 10, "2018-01-01", "2018-02-01", "N"), (2, 1, 10, "2019-01-01", "2019-02-01", "N"), (3, 3, 10, "2019-01-01", None, "N")),
        "services": t("ServiceID int, OrganizationID int", (10, 1), (11, 1)),
        "people_roles": t("PersonID int, PeopleRoleTypeID int", (101, 11), (103, 11)),
        "people_groups": t("PersonID int, GroupID int, PeopleRelationshipTypeID int, DateEnd string, GroupRoleTypeID int", (101, 7, 1, None, 1), (103, 7, 1, None, 9)),
        "groups": t("GroupID int, DateEnd string", (7, None)),
        "relationship_types": t(codes, (1, "Parent")),
        "clients": t("ClientID int, PersonID int, CountryOfBirthID int, ProvinceOfBirthID int, CityOfBirthID int, EyeColorTypeID int, HairColorTypeID int, "
                     "ClientStateTypeID int, CurrentAge double", (1, 101, 1, 1, 1, 1, 1, 1, 30.0), (2, 102, 1, 1, 1, 1, 1, 1, 40.0), (3, 103, None, 1, 1, 1, 1, 1, 50.0)),
        "people": t("PersonID int, DOB string", (101, "1980-01-01"), (102, "1980-01-01"), (103, "1980-01-01")),
        **{n: t(codes, (1, n)) for n in ("country_types", "province_types", "city_types", "eye_colour_types", "hair_colour_types", "income_types", "expense_types",
                                         "frequency_types", "education_types", "health_issue_types", "contributing_types", "behaviour_types", "probability_types",
                                         "life_event_types", "diet_types", "food_types", "barred_reasons", "module_types", "prescreen_types",
                                         "HistoryOfHousing_types", "CommonPlace_types", "HealthCare_types", "FamilyHousing_types")},
        "client_services": t("ClientID int, ServiceID int, ServiceType string, DateStart string, DateEnd string, ReasonForService string, OrganizationName string",
                             (1, 10, "Stay", "2020-01-01", None, "cold", "House"), (2, 11, "Stay", "2020-01-01", None, None, "House")),
        "incomes": t("ClientID int, IncomeTypeID int, MonthlyAmount double, DateStart string, DateEnd string, createdDate string",
                     (1, 1, 100.0, "2020-01-01", None, None), (1, 1, 200.0, "2020-01-01", None, "2020-01-01")),
        "expenses": t("ClientExpenseID int, ClientID int, ExpenseTypeID int, PayFrequencyTypeID int, ExpenseAmount double, IsEssentialYN string, DateStart string, DateEnd string",
                      (5, 1, 1, 1, 9.0, "Y", "2020-01-02", None)),
        "education": t("ClientID int, EducationLevelTypeID int, DateStart string, DateEnd string", (1, 1, "2001-01-01", None)),
        "medications": t("ClientID int, HealthIssueID int, MedicationName string, DateStart string, DateEnd string", (1, 4, "m1", "2020-01-01", None), (1, None, "m2", "2020-01-01", None)),
        "health_issues": t("HealthIssueID int, ClientID int, HealthIssueTypeID int, DiagnosedYN string, SelfReportedYN string, SuspectedYN string, DateFrom string, DateTo string",
                           (4, 1, 1, "Y", "N", "N", "2020-01-01", None)),
        "contributing_factors": t("clientContributingFactorID int, ClientID int, ContributingTypeID int, DateStart string, DateEnd string", (1, 1, 1, "2020-01-01", None)),
        "behaviours": t("ClientBehaviouralFactorID int, ClientID int, BehavioralTypeID int, ProbabilityTypeID int, DateStart string, DateEnd string", (1, 1, 1, 1, "2020-01-01", None)),
        "life_events": t("PeopleLifeEventID int, PersonID int, LifeEventTypeID int, DateStart string, DateEnd string", (1, 101, 1, "2020-01-01", None), (2, 101, 1005, "2020-01-01", None)),
        "diets": t("ClientDietID int, ClientID int, DietCategoryTypeID int, DietFoodItemTypeID int, AvoidedDietYN string, CreatedDate string", (1, 1, 1, 1, "N", "2020-01-01")),
        "intakes": t("IntakeID int, ServiceID int, IntakeType int, PreScreenPeriodTypeID int, StartDateTime string, LastUpdatedDate string", (8, 10, 1, 1, "2020-03-01", "2020-03-02"), (9, 10, 2, 1, "2020-03-01", "2020-03-02")),
        "intake_types": t(codes, (1, "VI-form"), (2, "other")),
        "scores": t("IntakeID int, TotalScore double", (8, 11.0), (9, 5.0)),
        "client_service_links": t("ServiceID int, ClientID int", (10, 1)),
        "barred_periods": t("ClientBarredPeriodID int, ClientID int, DateStart string, DateEnd string, ReasonBarredTypeID int",
                            (1, 1, "2020-01-01", None, 1), (2, 1, "2016-01-01", None, 1), (3, 2, "2020-01-01", None, 1)),
        "barred_organizations": t("ClientBarredPeriodID int, OrganizationID int", (1, 1), (2, 1), (3, 1)),
        "barred_modules": t("ClientBarredPeriodID int, ServiceRestrictionModuleTypeID int", (1, 1), (1, 1)),
        "answered": t("IntakeID int, AssessmentQuestionID int, ScoreValue int, ScoreYN string, HistoryOfHousingTypeID int, CommonPlaceTypeID int, HealthCareTypeID int, "
                      "FamilyHousingTypeID int, RefusedYN string", (8, 1, 3, None, None, None, None, None, "N"), (8, 2, None, None, None, 1, None, None, "N")),
        "questions": t("AssessmentQuestionID int, Component string, QuestionE string, DescriptionE string", (1, "1", "a, b", "d,"), (2, "a", "c", "e")),
    }


def test_full_export(spark):
    src = small_source(spark)
    out = X.export(src, "2020-06-01 00:00:00")
    assert tuple(out.columns) == EXPORT_COLUMNS
    rows = out.collect()
    assert {r["ClientID"] for r in rows} == {1}                # 2 has no valid consent, 3 no service
    assert {r["ConsentType"] for r in rows} == {"Explicit"}
    assert sorted(r["ServiceType"] for r in rows) == sorted([
        "Stay", "Income", "Expenses", "Education", "HealthIssues", "Medications", "Contributing Factor", "Behavioral Risk Factor",
        "Life Events", "Diet", "VISPDAT", "Service Restriction"])
    by = {r["ServiceType"]: r for r in rows}
    assert by["Stay"]["InHousing"] == "Y" and by["Stay"]["MovedInDate"].year == 2019 and by["Stay"]["FamilyID"] == 7
    assert by["Income"]["MonthlyAmount"] == 100.0 and by["HealthIssues"]["HealthIssuesMedicationName"] == "m1"
    assert by["Medications"]["OtherMedications"] == "m2" and by["VISPDAT"]["TotalScore"] == 11.0
    assert by["Service Restriction"]["Modules"] == "module_types|module_types" and by["Diet"]["DateStart"].year == 2020
    answers = {r["AssessmentQuestionID"]: r for r in X.answers_export(src).collect()}
    assert answers[1]["QuestionE"] == "a b" and answers[1]["ScoreValue"] == "3" and answers[2]["ScoreValue"] == "CommonPlace_types"


def test_series_job_round_trip(spark, tmp_path):
    rows = Tables(spark, "/root/testdata/sf0.001").raw_episodes()
    ds = jobs.preprocess(rows, CFG, str(tmp_path / "series"), series=True)
    assert ds.keys == ("ClientID", "Date") and dict(ds.features.dtypes)["Date"] == "date"
    assert ds.features.count() == ds.encoded.count() > 0
    pruned = ds.encoded.where(F.col("Date") == F.lit("2024-01-24").cast("date"))
    assert "PartitionFilters: [isnotnull(Date" in pruned._jdf.queryExecution().toString()
    roles = {r["role"] for r in jobs.split_roles(ds, CFG).select("role").distinct().collect()}
    assert roles == {"train", "val", "test"}
    assert jobs.inputs(ds)[-1].startswith("3-Day_")
