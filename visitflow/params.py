"""Study parameters, category levels and code sets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# --- Fixed values: code sets, category levels, band edges and labels ---------------------------------
NUMERIC_SENTINELS = {
    "admincat": (99,),
    "atentype": (13,),
    "attended": (9,),
    "outcome": (9,),
    "priority": (9,),
    "refsourc": (99,),
    "servtype": (9,),
    "stafftyp": (9, 99),
}
TEXT_SENTINELS = {"firstatt": ("X", "9")}
INFANT_AGE_CODES = (7001, 7002, 7003, 7004, 7005, 7006, 7007)

NEW_CODES = (1, 3)
FOLLOW_UP_CODES = (2, 4)
ATTENDED_CODES = (5, 6)
CANCELLED_CODES = (2, 4)
DISCHARGED_CODES = (1,)
CONTINUING_CODES = (2, 3)

NEW, FOLLOW_UP = "New", "Follow up"
ATTENDED, CANCELLED, MISSED = "Attended", "Cancelled", "Did Not Attend"
NEW_REFERRAL, DISCHARGED, UNKNOWN = "New referral", "Discharged", "Unknown"

TYPE_LEVELS = (NEW, FOLLOW_UP)
ATTENDANCE_LEVELS = (ATTENDED, CANCELLED, MISSED)
BAND_EDGES = (0, 1, 6, 17, 30, 41, float("inf"))
BAND_LABELS = ("1 week", "1 month", "3 months", "6 months", "9 months", "12 months")
LAST_LEVELS = BAND_LABELS + (NEW_REFERRAL, UNKNOWN)
NEXT_LEVELS = BAND_LABELS + (DISCHARGED, UNKNOWN)

DEDUPE_KEYS = (
    "patid", "admincat", "apptdate", "atentype", "attended", "dnadate", "firstatt", "outcome", "priority",
    "refsourc", "reqdate", "servtype", "stafftyp", "wait_ind", "waiting", "hes_yr", "tretspef", "mainspef",
)
# Keys that a table may lack.
OPTIONAL_KEYS = ("dnadate", "mainspef", "wait_ind", "waiting")
REQUIRED_FIELDS = ("tretspef", "firstatt", "attended")
DROPPED_FIELDS = ("apptage", "atentype")
SUMMARY_FIELDS = (
    "ethnos", "admincat", "attended", "firstatt", "outcome", "priority", "refsourc", "servtype", "stafftyp",
    "tretspef_name", "discharged",
)
# -----------------------------------------------------------------------------------------------------

NA_TEXT = "NA"


@dataclass(frozen=True)
class StudyParams:
    """Dates, cohort selectors and thresholds of one study."""

    study_start: date = date(2015, 12, 1)
    sim_start: date = date(2016, 12, 1)
    sim_end: date = date(2017, 11, 30)
    check_start: date = date(2015, 12, 1)
    check_end: date = date(2016, 11, 26)
    calendar_start: date = date(2010, 1, 1)
    include_start: bool = False
    specialty: str = "307"
    types: tuple[str, ...] = ("type1", "type2")
    gap_threshold_weeks: int = 104

    @property
    def sim_weeks(self) -> int:
        """Number of relative weeks in the simulation window (the last one may be short)."""
        return -(-((self.sim_end - self.sim_start).days + 1) // 7)
