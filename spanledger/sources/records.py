"""The supplied star schema read as the normalised tables of the whole export.

Codes are nation and region keys; keys modulo 27 leave some codes without a name. Table names are
those that ``operators.export.export`` and ``answers_export`` expect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanledger.sources.adapters import Tables

#: Consent type that is taken only where there is no other.
SECOND_CHOICE = "CHINA"
#: Restrictions are dated from 2017 on, orders from 1992 to 1998.
SHIFT_DAYS = 7305


def _yn(c: Column) -> Column:
    return F.when(c, "Y").otherwise("N")


def _open_end(k: Column) -> Column:
    """Null, past or future end of a membership, as of 1999."""
    return F.when(k % 7 == 0, None).when((k % 7).isin(1, 2), F.lit("1998-01-01").cast("timestamp")).otherwise(F.lit("2000-01-01").cast("timestamp"))


def code_tables(t: Tables) -> dict[str, DataFrame]:
    nations = t.nation.select(F.col("n_nationkey").alias("ID"), F.col("n_name").alias("NameE"))
    regions = t.region.select(F.col("r_regionkey").alias("ID"), F.col("r_name").alias("NameE"))
    # Code tables by what stands for them.
    by_nation = ("consent_types", "relationship_types", "country_types", "province_types", "city_types", "income_types", "expense_types",
                 "education_types", "health_issue_types", "contributing_types", "behaviour_types", "life_event_types", "diet_types",
                 "barred_reasons", "module_types", "HistoryOfHousing_types", "CommonPlace_types")
    by_region = ("eye_colour_types", "hair_colour_types", "frequency_types", "probability_types", "food_types", "prescreen_types",
                 "HealthCare_types", "FamilyHousing_types")
    kinds = nations.withColumn("NameE", F.concat(F.when(F.col("ID") % 2 == 0, "VI-").otherwise(""), "NameE"))
    return {n: nations for n in by_nation} | {n: regions for n in by_region} | {"intake_types": kinds}


def client_tables(t: Tables) -> dict[str, DataFrame]:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    person = (k * 2 + 1).alias("PersonID")
    members = (t.customer.select(person, F.col("c_nationkey").alias("GroupID"), _open_end(k).alias("DateEnd"), (k % 11).alias("GroupRoleTypeID"),
                                 (k % 27).alias("PeopleRelationshipTypeID"))
               .unionByName(t.supplier.select(
                   (F.col("s_suppkey") * 2 + 1).alias("PersonID"), F.col("s_nationkey").alias("GroupID"), _open_end(F.col("s_suppkey")).alias("DateEnd"),
                   F.lit(1).cast("long").alias("GroupRoleTypeID"), F.col("s_suppkey").alias("PeopleRelationshipTypeID"))))
    return {
        "organizations": t.supplier.select(F.col("s_suppkey").alias("OrganizationID"), (F.col("s_nationkey") % 2 + 16).alias("ClusterID"),
                                           F.col("s_name").alias("Name")),
        "consents": t.consents().drop("ConsentType").withColumn("ConsentTypeID", F.col("ConsentID") % 25),
        "consent_providers": t.orders.select(o.alias("ConsentID"), (o % 100).alias("OrgID")),
        "services": t.orders.select(o.alias("ServiceID"), (o % 100).alias("OrganizationID")),
        "placements": t.orders.select(
            o.alias("HousePlacementID"), o.alias("ServiceID"), F.col("o_custkey").alias("PrimaryClientID"),
            F.col("o_orderdate").alias("DateSearchStarted"), F.when(o % 6 != 0, F.col("o_orderdate")).alias("MovedInDate"),
            F.when(F.col("o_orderstatus") == "O", "N").otherwise("Y").alias("PlacementEndedYN")),
        "people_roles": t.customer.select(person, F.when(k % 3 == 0, 12).otherwise(11).alias("PeopleRoleTypeID")),
        "people_groups": members,
        "groups": t.nation.select(F.col("n_nationkey").alias("GroupID"),
                                  F.when(F.col("n_nationkey") % 5 == 0, F.lit("1998-06-01").cast("timestamp")).alias("DateEnd")),
        "clients": t.customer.select(
            k.alias("ClientID"), person, (k % 90).alias("CurrentAge"), F.col("c_mktsegment").alias("Gender"), _yn(k % 5 == 0).alias("AboriginalIndicator"),
            F.concat(F.lit("status "), k % 4).alias("Citizenship"), _yn(k % 13 == 0).alias("VeteranStatus"), (k % 27).alias("CountryOfBirthID"),
            F.when(k % 3 != 0, F.col("c_nationkey")).alias("ProvinceOfBirthID"), (k % 26).alias("CityOfBirthID"), (k % 7).alias("EyeColorTypeID"),
            (k % 6).alias("HairColorTypeID"), (150 + k % 50).alias("ClientHeightCM"), F.col("c_acctbal").alias("ClientWeightKG"),
            F.when(k % 4 != 0, 1).otherwise(2).alias("ClientStateTypeID")),
        "people": t.customer.select(person, F.timestamp_seconds(F.lit(86_400) * (k % 9000)).alias("DOB")),
    }


def record_tables(t: Tables) -> dict[str, DataFrame]:
    o, c, day = F.col("o_orderkey"), F.col("o_custkey").alias("ClientID"), F.col("o_orderdate")
    p = F.col("p_partkey")
    start = F.date_trunc("second", "ts")
    # Orders are hashed, so that their many lines are not sorted for the join.
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == o)
    return {
        "client_services": t.events.select(
            F.col("user_id").alias("ClientID"), F.col("event_id").alias("ServiceID"), F.col("event_type").alias("ServiceType"), start.alias("DateStart"),
            F.when(F.col("event_id") % 9 != 0, start + F.expr("interval 1 day")).alias("DateEnd"),
            F.concat(F.lit("reason "), F.col("event_id") % 5).alias("ReasonForService"), F.concat(F.lit("site "), F.col("user_id") % 3).alias("OrganizationName")),
        "incomes": t.orders.select(c, (o % 27).alias("IncomeTypeID"), F.col("o_totalprice").alias("MonthlyAmount"), day.alias("DateStart"),
                                   F.when(o % 3 == 0, day).alias("createdDate")),
        "expenses": lines.select(c, (o * 10 + F.col("l_linenumber")).alias("ClientExpenseID"), (F.col("l_suppkey") % 27).alias("ExpenseTypeID"),
                                 (F.col("l_partkey") % 6).alias("PayFrequencyTypeID"), F.col("l_extendedprice").alias("ExpenseAmount"),
                                 F.col("l_shipdate").alias("DateStart"), _yn(F.col("l_returnflag") == "R").alias("IsEssentialYN")),
        "education": t.orders.where(o % 4 == 1).select(c, (o % 27).alias("EducationLevelTypeID"), day.alias("EducationStartDate"),
                                                       (day + F.expr("interval 30 days")).alias("EducationEndDate")),
        "health_issues": t.orders.where("o_orderstatus = 'F'").select(
            c, o.alias("HealthIssueID"), (o % 27).alias("HealthIssueTypeID"), day.alias("DateFrom"), F.when(o % 2 == 0, day).alias("DateTo"),
            _yn(o % 2 == 0).alias("DiagnosedYN"), _yn(o % 3 == 0).alias("SelfReportedYN"), _yn(o % 5 == 0).alias("SuspectedYN")),
        "medications": t.part.select((p % 500).alias("ClientID"), F.when(p % 4 != 0, p * 2).alias("HealthIssueID"), F.col("p_brand").alias("MedicationName")),
        "contributing_factors": t.orders.where(o % 4 == 2).select(c, o.alias("clientContributingFactorID"), (o % 26).alias("ContributingTypeID"), day.alias("DateStart")),
        "behaviours": t.orders.where(o % 4 == 3).select(c, o.alias("ClientBehaviouralFactorID"), (o % 26).alias("BehavioralTypeID"),
                                                        (o % 6).alias("ProbabilityTypeID"), day.alias("DateStart")),
        "life_events": t.orders.select((F.col("o_custkey") * 2 + 1).alias("PersonID"), o.alias("PeopleLifeEventID"),
                                       F.when(o % 10 == 0, 1005).otherwise(o % 26).alias("LifeEventTypeID"), day.alias("DateStart")),
        "diets": t.orders.where(o % 7 == 0).select(c, o.alias("ClientDietID"), (o % 26).alias("DietCategoryTypeID"), (o % 6).alias("DietFoodItemTypeID"),
                                                   _yn(o % 2 == 0).alias("AvoidedDietYN"), day.alias("CreatedDate")),
        "barred_periods": t.orders.select(o.alias("ClientBarredPeriodID"), c, F.date_add(day, SHIFT_DAYS).cast("timestamp").alias("DateStart"),
                                          (o % 26).alias("ReasonBarredTypeID")),
        "barred_organizations": t.orders.select(o.alias("ClientBarredPeriodID"), (o % 100).alias("OrganizationID")),
        "barred_modules": t.lineitem.select(F.col("l_orderkey").alias("ClientBarredPeriodID"), (F.col("l_suppkey") % 27).alias("ServiceRestrictionModuleTypeID")),
    }


def intake_tables(t: Tables) -> dict[str, DataFrame]:
    o, q, line = F.col("o_orderkey"), F.col("l_quantity").cast("int"), F.col("l_linenumber")
    return {
        "intakes": t.orders.select(o.alias("IntakeID"), o.alias("ServiceID"), (o % 26).alias("IntakeType"), (o % 7).alias("PreScreenPeriodTypeID"),
                                   F.col("o_orderdate").alias("StartDateTime")),
        "scores": t.orders.select(o.alias("IntakeID"), F.when(F.col("o_orderpriority") != "5-LOW", o % 18).alias("TotalScore")),
        "client_service_links": t.orders.select(o.alias("ServiceID"), F.col("o_custkey").alias("ClientID")),
        "answered": t.lineitem.select(
            F.col("l_orderkey").alias("IntakeID"), F.col("l_partkey").alias("AssessmentQuestionID"), F.col("l_shipdate").alias("LastUpdatedDate"),
            F.when(q > 25, q).alias("ScoreValue"), F.when(F.col("l_returnflag") == "R", "Y,es").alias("ScoreYN"),
            F.when(line == 1, F.col("l_suppkey") % 27).alias("HistoryOfHousingTypeID"), F.when(line == 2, F.col("l_suppkey") % 27).alias("CommonPlaceTypeID"),
            F.when(line == 3, q % 6).alias("HealthCareTypeID"), (q % 6).alias("FamilyHousingTypeID"), _yn(q == 1).alias("RefusedYN")),
        "questions": t.part.select(F.col("p_partkey").alias("AssessmentQuestionID"), (F.col("p_size")).cast("string").alias("Component"),
                                   F.concat("p_name", F.lit(", "), "p_type").alias("QuestionE"), F.concat("p_type", F.lit(",...")).alias("DescriptionE")),
    }


def export_tables(t: Tables) -> dict[str, DataFrame]:
    """Every table of the export, by name."""
    return code_tables(t) | client_tables(t) | record_tables(t) | intake_tables(t)
