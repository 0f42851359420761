"""Fixed values of the business rules.

Everything in this file is a fixed value: it must be spelled exactly like this
for the report to be right. Lists are in their natural order.
"""

# Disciplines whose visits enter the report.
DISCIPLINES = ("OT", "PT", "SN", "ST", "MSW", "HHA")

# Fixed value: the discipline reported as its own visit type.
AIDE = "HHA"

# Visit statuses that mean "not completed".
OPEN_STATUSES = (
    "Missed Visit (Approved) (MV)",
    "Missed Visit",
    "Not Started",
    "Not Started (MV)",
    "Submitted with Signature (MV)",
    "Returned for Review (MV)",
    "Not Yet Due",
    "Not Yet Due (MV)",
    "Saved (MV)",
)

# Surnames used for test patients.
TEST_SURNAMES = ("Again", "Test", "Test2", "Test3", "ZZZZ")

# Tasks that are never priced.
UNPRICED_TASKS = (
    "OASIS-D1 Death",
    "OT Discharge (Non-Billable)",
    "OASIS-D1 Transfer",
    "OASIS-D1 Discharge (Non-Billable)",
    "Discharge Summary",
    "MSW Discharge (Non-Billable)",
    "Aide Supervisory Visit",
    "OASIS-D1 Transfer (PT)",
    "PT Discharge (Non-Billable)",
    "OASIS-D1 Discharge (Non-Billable) - PT",
    "LPN 1/Month Supervisory Visit",
    "OASIS-D1 Transfer (OT)",
    "OASIS-D1 Transfer (ST)",
    "OASIS-D1 Discharge (Non-Billable) - OT",
    "Skilled Nurse Visit (Non-Billable)",
    "Discharge Summary (ST)",
    "Discharge Summary (OT)",
    "Discharge Summary (PT)",
    "Transfer Summary",
    "OASIS-D1 Death (PT)",
    "Aide Care Plan",
)

# Claim statuses that void a claim.
VOID_CLAIM_STATUSES = ("Void", "Claim Cancelled", "Auto-Cancelled")

# Insurers left out of the receivables.
PRIVATE_PAYERS = ("Private Pay1", "Private Pay", "10 PRIVATE PAY")

# Payment models and rate types.
PER_VISIT = "Per Visit Payment"
EPISODIC = "Episodic Payment"
HOURLY = "Hourly"
UNIT = "Unit"

# The flag of a PDGM payer and its default.
PDGM = "PDGM"
NON_PDGM = "Non PDGM"

# Fixed value: type of bill of a request for anticipated payment.
ADVANCE_TYPE_OF_BILL = "322"

# Quarter-hour credit by whole minutes, upper bound inclusive;
# anything above the last bound counts as a full hour.
QUARTER_CUTS = ((7, 0.0), (22, 0.25), (37, 0.5), (52, 0.75))

# Ageing buckets in days, both ends inclusive; None is open.
AGE_BUCKETS = (
    ("0 to 30", 0, 30),
    ("31 to 60", 31, 60),
    ("61 to 90", 61, 90),
    ("91 to 120", 91, 120),
    ("121 to 180", 121, 180),
    ("181 to 240", 181, 240),
    ("241 to 300", 241, 300),
    ("301 to 365", 301, 365),
    ("> 365", 366, None),
)
