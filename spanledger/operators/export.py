"""The raw export: twelve kinds of client records as one wide table.

Every join leaves its strategy to Catalyst: code tables fall under the broadcast threshold by their
size, the rest is shuffled, and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.sources.readers import EXPORT_COLUMNS, episode_schema

# Fixed value: length a cast to national text keeps when none is given.
TEXT_WIDTH = 30
# Fixed value: first day whose restrictions were recorded in the application itself.
RESTRICTIONS_SINCE = "2017-07-01"


def lookup(df: DataFrame, codes: DataFrame, key: str, out: str, how: str = "inner", code_id: str = "ID",
           name: str = "NameE") -> DataFrame:
    """Adds the name of a code."""
    c = codes.select(F.col(code_id).alias("_code"), F.col(name).alias(out))
    return df.join(c, F.col(key) == F.col("_code"), how).drop("_code")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in the given ordering values; a mergeable ``min`` instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                                                 F.struct(*rest).alias("row"))).alias("_m"))
            .select(*keys, "_m.row.*"))


def consent_pick(consents: DataFrame, now: str, second_choice, extra: tuple[str, ...] = ()) -> DataFrame:
    """One valid consent per client, any type before ``second_choice``; then earliest expiry, then id."""
    t = F.lit(now).cast("timestamp")
    valid = consents.where((F.col("StartDate") <= t) & (F.col("ExpiryDate").isNull() | (F.col("ExpiryDate") >= t)))
    one = valid.groupBy("ClientID", "ConsentType", "ConsentID", *extra).agg(F.min("ExpiryDate").alias("ExpiryDate"))
    late = (F.col("ConsentType") == second_choice).cast("int")
    return first_by(one, ["ClientID"], late, F.col("ExpiryDate").isNull(), F.col("ExpiryDate"), F.col("ConsentID"))


def latest_placement(placements: DataFrame, tie: str) -> DataFrame:
    """Newest open placement with a move-in date per client."""
    rest = [c for c in placements.columns if c not in ("ClientID",)]
    return (placements.where((F.col("PlacementEndedYN") == "N") & F.col("MovedInDate").isNotNull())
            .groupBy("ClientID")
            .agg(F.max(F.struct("DateSearchStarted", "MovedInDate", tie, F.struct(*rest).alias("row"))).alias("_m"))
            .select("ClientID", "_m.row.*"))


def active_groups(members: DataFrame, groups: DataFrame, client_people: DataFrame, now: str, left_role: int) -> DataFrame:
    """Memberships open on both sides, of people who are clients, in another role than ``left_role``."""
    t = F.lit(now).cast("timestamp")

    def still_open(c):
        return F.col(c).isNull() | (F.col(c) > t)
    return (members.where(still_open("DateEnd") & (F.col("GroupRoleTypeID") != left_role))
            .join(groups.select("GroupID", F.col("DateEnd").alias("GroupEnd")).where(still_open("GroupEnd")), "GroupID")
            .join(client_people, "PersonID", "left_semi"))


def client_basics(clients: DataFrame, consent: DataFrame, placement: DataFrame, families: DataFrame,
                  lookups: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Star join of the person attributes. ``lookups``: output column -> (code table, key column).

    A client in several groups gives several rows, as in the export.
    """
    df = clients.join(consent.select("ClientID", "ConsentType"), "ClientID")
    for out, (codes, key) in lookups.items():
        df = lookup(df, codes, key, out, "left")
    return (df.join(placement.select("ClientID", "MovedInDate"), "ClientID", "left")
            .join(families.select("PersonID", F.col("GroupID").alias("FamilyID"), "RelationshipType"), "PersonID", "left")
            .withColumn("InHousing", F.when(F.col("MovedInDate").isNotNull(), "Y").otherwise("N")))


def known_only(df: DataFrame, known: DataFrame, key: str = "ClientID") -> DataFrame:
    """Rows whose key occurs in ``known``; distinct keys are combined map-side first."""
    return df.join(known.select(key).distinct(), key, "left_semi")


def incomes(df: DataFrame, types: DataFrame) -> DataFrame:
    return lookup(df.where(F.col("createdDate").isNull()), types, "IncomeTypeID", "IncomeType")


def expenses(df: DataFrame, types: DataFrame, frequencies: DataFrame) -> DataFrame:
    return lookup(lookup(df, types, "ExpenseTypeID", "ExpenseType"), frequencies, "PayFrequencyTypeID", "ExpenseFrequency")


def health_issues(df: DataFrame, types: DataFrame, medications: DataFrame) -> DataFrame:
    meds = medications.select("HealthIssueID", F.col("MedicationName").alias("HealthIssuesMedicationName"))
    return lookup(df, types, "HealthIssueTypeID", "HealthIssue").join(meds, "HealthIssueID", "left")


def free_medications(df: DataFrame) -> DataFrame:
    return df.where(F.col("HealthIssueID").isNull())


def life_events(df: DataFrame, types: DataFrame, clients: DataFrame, ignored: int = 1005) -> DataFrame:
    return (lookup(df.where(F.col("LifeEventTypeID") != ignored), types, "LifeEventTypeID", "LifeEvent")
            .join(clients.select("PersonID", "ClientID"), "PersonID"))


def restrictions(df: DataFrame, reasons: DataFrame, organizations: DataFrame, consent: DataFrame,
                 since: str = RESTRICTIONS_SINCE) -> DataFrame:
    """Restrictions of consenting clients recorded since the application came into use."""
    df = known_only(df.where(F.to_date("DateStart") >= F.lit(since).cast("date")), consent)
    df = lookup(df, reasons, "ReasonBarredTypeID", "Reason")
    return lookup(df, organizations, "OrganizationID", "ServiceRestricitonOrganizationName", code_id="OrganizationID", name="Name")


def text_list(df: DataFrame, key: str, item: str, out: str, sep: str = "|", width: int = TEXT_WIDTH) -> DataFrame:
    """Items of a key in order, joined by ``sep`` and cut to ``width`` characters.

    Each item takes at least its separator, so the first ``width + 1`` rows decide the text. They are found by one sort per key, of
    which every task of the input first keeps so many rows of a key; no table of pairs is held.
    """
    most = width + 1
    first = W.partitionBy(key).orderBy(item)
    whole = first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (df.select(key, item).where(F.col(item).isNotNull()).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= most)
            .withColumn("_items", F.collect_list(item).over(whole)).where(F.col("_rn") == 1)
            .select(key, F.left(F.array_join("_items", sep), F.lit(width)).alias(out)))


def assessments(intakes: DataFrame, word: str = "VI") -> DataFrame:
    """Scored intakes of the wanted kind, active clients only."""
    return intakes.where(F.col("TotalScore").isNotNull() & (F.col("ClientStateTypeID") == 1)
                         & F.col("SPDAT_Type").contains(word))


def answer_text(*sources: Column) -> Column:
    """First filled answer source as text without commas."""
    return F.regexp_replace(F.coalesce(*[s.cast("string") for s in sources]), ",", "")


def padded(df: DataFrame, kind: str | None, columns: tuple[str, ...] = EXPORT_COLUMNS) -> DataFrame:
    """A record branch as the wide row: missing columns typed null, ``kind`` as its service type."""
    types = {f.name: f.dataType for f in episode_schema(columns).fields}
    if kind is not None:
        df = df.withColumn("ServiceType", F.lit(kind))
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c)
                       for c in columns])


def episode_union(basics: DataFrame, branches: Mapping[str | None, DataFrame], columns: tuple[str, ...] = EXPORT_COLUMNS,
                  key: str = "ClientID") -> DataFrame:
    """All record branches in one table, client attributes on each row.

    The narrow branches are united first, so the client attributes are joined once rather than once
    per branch. Branch names are the service types; the branch named None brings its own. Clients are
    hashed, so that the wide records are not sorted for the join.
    """
    narrow = [c for c in columns if c == key or c not in basics.columns]
    out = None
    for kind, df in branches.items():
        rows = padded(df, kind, tuple(narrow))
        out = rows if out is None else out.unionByName(rows)
    return out.join(basics.hint("shuffle_hash"), key).select(*[F.col(c) for c in columns])


def episode_export(union: DataFrame, services: DataFrame, ordered: bool = False) -> DataFrame:
    """Clients with at least one service; ordered only for a sink that wants it (a range sort)."""
    out = known_only(union, services)
    return out.orderBy("ClientID", "DateStart", "DateEnd") if ordered else out


def detail_branches(src: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The nine detail records of clients by service type, codes named, columns as in the export."""
    meds = src["medications"]
    return {
        "Income": incomes(src["incomes"], src["income_types"]).withColumn("ReasonForService", F.col("IncomeType")),
        "Expenses": expenses(src["expenses"], src["expense_types"], src["frequency_types"]),
        "Education": lookup(src["education"], src["education_types"], "EducationLevelTypeID", "EducationLevel"),
        "HealthIssues": health_issues(src["health_issues"], src["health_issue_types"], meds)
        .withColumnsRenamed({"DateFrom": "DateStart", "DateTo": "DateEnd"}),
        "Medications": free_medications(meds).withColumnRenamed("MedicationName", "OtherMedications").drop("HealthIssueID"),
        "Contributing Factor": lookup(src["contributing_factors"], src["contributing_types"], "ContributingTypeID", "ContributingFactor"),
        "Behavioral Risk Factor": lookup(lookup(src["behaviours"], src["behaviour_types"], "BehavioralTypeID", "BehavioralFactor"),
                                         src["probability_types"], "ProbabilityTypeID", "Severity"),
        "Life Events": life_events(src["life_events"], src["life_event_types"], src["clients"]),
        "Diet": lookup(lookup(src["diets"], src["diet_types"], "DietCategoryTypeID", "DietCatetory"),
                       src["food_types"], "DietFoodItemTypeID", "FoodType").withColumnRenamed("CreatedDate", "DateStart"),
    }


def export(src: Mapping[str, DataFrame], now: str, second_choice: str = "Declined", cluster: int = 16) -> DataFrame:
    """The whole export over normalised tables; see README for the table names it expects."""
    orgs = src["organizations"].where(F.col("ClusterID") == cluster)
    consents = (lookup(src["consents"].join(src["consent_providers"], "ConsentID"), src["consent_types"], "ConsentTypeID", "ConsentType")
                .join(orgs.select("OrganizationID"), F.col("OrgID") == F.col("OrganizationID"), "left_semi"))
    consent = consent_pick(consents, now, second_choice, extra=("OrgID",))
    placed = (src["placements"].join(src["services"].select("ServiceID", "OrganizationID"), "ServiceID")
              .join(orgs.select("OrganizationID"), "OrganizationID", "left_semi")
              .withColumnRenamed("PrimaryClientID", "ClientID"))
    placement = latest_placement(placed, "HousePlacementID")
    client_people = src["people_roles"].where(F.col("PeopleRoleTypeID") == 11).select("PersonID").distinct()
    families = lookup(active_groups(src["people_groups"], src["groups"], client_people, now, left_role=9),
                      src["relationship_types"], "PeopleRelationshipTypeID", "RelationshipType")
    codes = {"CountryOfBirth": ("country_types", "CountryOfBirthID"), "ProvinceOfBirth": ("province_types", "ProvinceOfBirthID"),
             "CityOfBirth": ("city_types", "CityOfBirthID"), "EyeColour": ("eye_colour_types", "EyeColorTypeID"),
             "HairColour": ("hair_colour_types", "HairColorTypeID")}
    people = src["clients"].join(src["people"].select("PersonID", "DOB"), "PersonID")
    basics = client_basics(people, consent, placement, families, {o: (src[t], k) for o, (t, k) in codes.items()})
    keep = [c for c in EXPORT_COLUMNS[:20] if c in basics.columns]
    basics = basics.select(*keep)
    # Consent alone parts off most services here, the join with the attributes the rest; its clients are hashed, so that services are not sorted.
    services = src["client_services"].join(consent.select("ClientID").hint("shuffle_hash"), "ClientID", "left_semi")
    barred = restrictions(src["barred_periods"].join(src["barred_organizations"], "ClientBarredPeriodID"), src["barred_reasons"],
                          src["organizations"], consent)
    # Modules of the restrictions that are exported, not of all; their keys are hashed, so that the modules are not sorted for it.
    own = src["barred_modules"].join(barred.select("ClientBarredPeriodID").hint("shuffle_hash"), "ClientBarredPeriodID", "left_semi")
    modules = text_list(lookup(own, src["module_types"], "ServiceRestrictionModuleTypeID", "Module"),
                        "ClientBarredPeriodID", "Module", "Modules")
    scored = lookup(src["intakes"].join(src["scores"], "IntakeID")
                    .join(src["services"].select("ServiceID", "OrganizationID"), "ServiceID")
                    .join(src["client_service_links"], "ServiceID")
                    .join(src["clients"].select("ClientID", "ClientStateTypeID"), "ClientID"),
                    src["intake_types"], "IntakeType", "SPDAT_Type")
    scored = lookup(lookup(scored, src["prescreen_types"], "PreScreenPeriodTypeID", "PreScreenPeriod", "left"),
                    orgs, "OrganizationID", "OrganizationName", code_id="OrganizationID", name="Name")
    # Service types of the record branches, in export order.
    branches = {
        None: services,
        **detail_branches(src),
        "VISPDAT": assessments(scored).withColumnRenamed("StartDateTime", "DateStart"),
        "Service Restriction": barred.join(modules, "ClientBarredPeriodID", "left"),
    }
    return episode_export(episode_union(basics, branches), services)


def answers_export(src: Mapping[str, DataFrame], cluster: int = 16) -> DataFrame:
    """One row per answered question of the scored intakes, texts free of commas."""
    orgs = src["organizations"].where(F.col("ClusterID") == cluster).select("OrganizationID", F.col("Name").alias("ServiceProvider"))
    df = (src["intakes"].join(src["scores"], "IntakeID").join(src["services"].select("ServiceID", "OrganizationID"), "ServiceID")
          .join(src["client_service_links"], "ServiceID")
          .join(src["clients"].select("ClientID", "PersonID", "ClientStateTypeID", "CurrentAge"), "ClientID")
          .join(orgs, "OrganizationID"))
    df = lookup(lookup(df, src["intake_types"], "IntakeType", "SPDAT_Type"), src["prescreen_types"], "PreScreenPeriodTypeID",
                "PreScreenPeriod", "left")
    df = assessments(df).join(src["answered"], "IntakeID").join(src["questions"], "AssessmentQuestionID")
    for out in ("HistoryOfHousing", "CommonPlace", "HealthCare", "FamilyHousing"):
        df = lookup(df, src[f"{out}_types"], f"{out}TypeID", out, "left")
    return df.select(
        "IntakeID", "ClientID", "CurrentAge", "SPDAT_Type", "PreScreenPeriod", F.col("StartDateTime").alias("SPDAT_Date"),
        "LastUpdatedDate", "OrganizationID", "ServiceProvider", "AssessmentQuestionID", "Component",
        F.regexp_replace("QuestionE", ",", "").alias("QuestionE"), F.regexp_replace("DescriptionE", ",", "").alias("DescriptionE"),
        answer_text(F.col("ScoreValue"), F.col("ScoreYN"), F.col("HistoryOfHousing"), F.col("CommonPlace"), F.col("HealthCare"),
                    F.col("FamilyHousing")).alias("ScoreValue"), "RefusedYN", "TotalScore")
