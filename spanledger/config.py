"""Job settings, as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY = 86_400
MIN_STAY_SECONDS = 15 * 60


@dataclass(frozen=True)
class SeriesSettings:
    step_days: int = 30
    t_x: int = 6
    years_of_data: float = 3
    folds: int = 10


@dataclass(frozen=True)
class TrainSettings:
    train_split: float = 0.9
    val_split: float = 0.05
    test_split: float = 0.05
    pos_weight: float = 0.5
    # One of class_weight, random_oversample, smote, adasyn, none.
    imbalance: str = "none"
    metric_preference: tuple[str, ...] = ("recall", "f1score", "precision", "auc", "loss", "accuracy")
    num_runs: int = 150
    thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7)
    search_combinations: int = 100
    search_repeats: int = 2


@dataclass(frozen=True)
class ExplainSettings:
    kernel_width: float | None = 2.5
    num_features: int = 15
    num_samples: int = 60_000
    max_displayed_rules: int = 15
    pick_sample_fraction: float = 0.2
    pick_explanations: int = 15


@dataclass(frozen=True)
class ClusterSettings:
    k: int = 4
    n_runs: int = 15
    k_min: int = 2
    k_max: int = 20


@dataclass(frozen=True)
class HorizonSettings:
    n_min: int = 0
    n_max: int = 52
    n_interval: int = 13

    def weeks(self) -> list[int]:
        return list(range(self.n_min, self.n_max + self.n_interval, self.n_interval))


@dataclass(frozen=True)
class Settings:
    """Everything a job needs. ``label_date`` and ``run_ts`` are explicit: no job reads the clock."""

    label_date: str = "2024-01-31"
    run_ts: str = "2024-02-01 00:00:00"
    horizon_weeks: float = 26
    label_window_days: int = 365
    label_threshold_days: int = 180
    stay_service: str = "Stay"
    # The service kinds measured in days, and those counted per visit.
    timed_services: tuple[str, ...] = ("Stay", "Case Management", "Housing", "Housing Subsidy", "Storage")
    counted_services: tuple[str, ...] = ("Reservations", "Turnaways", "Food Bank", "Goods and Services", "SPDAT")
    client_exclusions: tuple[int, ...] = ()
    # Columns dropped before and after feature building.
    drop_first: tuple[str, ...] = (
        "MovedInDate", "OtherMedications", "DietCatetory", "FoodType", "ConsentType", "ClientHeightCM",
        "EyeColour", "HairColour", "ProvinceOfBirth", "CityOfBirth", "CountryOfBirth", "IntakeID",
        "clientContributingFactorID", "ClientBehaviouralFactorID", "PeopleLifeEventID", "ClientDietID",
        "ClientBarredPeriodID", "Modules", "ServiceRestricitonOrganizationName", "PersonID",
    )
    drop_last: tuple[str, ...] = ("ServiceID", "FamilyID", "MonthlyAmount", "DOB", "DateEnd")
    # Numeric and categorical columns of the episode table.
    numeric_features: tuple[str, ...] = (
        "ServiceID", "CurrentAge", "ClientHeightCM", "ClientWeightKG", "MonthlyAmount", "ExpenseAmount",
        "TotalScore",
    )
    categorical_features: tuple[str, ...] = (
        "ConsentType", "RelationshipType", "Gender", "AboriginalIndicator", "Citizenship", "VeteranStatus",
        "CountryOfBirth", "ProvinceOfBirth", "CityOfBirth", "HairColour", "EyeColour", "ServiceType",
        "OrganizationName", "ReasonForService", "InHousing", "IncomeType", "ExpenseType", "ExpenseFrequency",
        "IsEssentialYN", "EducationLevel", "HealthIssue", "DiagnosedYN", "SelfReportedYN", "SuspectedYN",
        "OtherMedications", "ContributingFactor", "BehavioralFactor", "Severity", "LifeEvent", "DietCatetory",
        "FoodType", "PreScreenPeriod", "Reason",
    )
    include_answers: bool = False
    answer_clients_only: bool = False
    answers_only: bool = False
    answers_root: str = "VISPDATS"
    kfolds: int = 10
    decision_threshold: float = 0.5
    class_names: tuple[str, str] = ("not at risk", "at risk")
    seed: int = 7
    series: SeriesSettings = field(default_factory=SeriesSettings)
    train: TrainSettings = field(default_factory=TrainSettings)
    explain: ExplainSettings = field(default_factory=ExplainSettings)
    cluster: ClusterSettings = field(default_factory=ClusterSettings)
    horizon: HorizonSettings = field(default_factory=HorizonSettings)

    @property
    def horizon_days(self) -> int:
        return round(self.horizon_weeks * 7)

    def anchors_for_training(self) -> int:
        """Anchors needed so that every kept row has a full look-back of ``t_x`` steps."""
        span = self.series.t_x * self.series.step_days + int(self.series.years_of_data * 365.25)
        return span // self.series.step_days
