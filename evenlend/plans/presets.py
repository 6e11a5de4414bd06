"""Fixed values of the credit study the jobs were built for: sentinels, column roles, label dictionaries.

Everything here is a parameter of the jobs and can be replaced for other tables.
"""

from __future__ import annotations

# Relative-day sentinel and the columns that use it.
DAY_SENTINEL = 365243
PREVIOUS_SENTINEL_COLUMNS = (
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
)
EXTERNAL_SCORES = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")
DOCUMENT_FLAGS = r"FLAG_DOC"
CONTACT_FLAGS = r"FLAG_(?!DOC)"

# Names of the six family-status codes in code order.
FAMILY_STATUS = ("civilmarriage", "married", "separated", "single", "unknown", "widow")
GENDERS = ("women", "men")
# Names of the occupation codes in code order; missing becomes "unknown".
OCCUPATIONS = (
    "Accountants",
    "Cleaning staff",
    "Cooking staff",
    "Core staff",
    "Drivers",
    "High skill tech staff",
    "HR staff",
    "IT staff",
    "Laborers",
    "Low-skill Laborers",
    "Managers",
    "Medicine staff",
    "Private service staff",
    "Realty agents",
    "Sales staff",
    "Secretaries",
    "Security staff",
    "Waiters/barmen staff",
    "unknown",
)
OTHER_OCCUPATIONS = {
    "other": (
        "Private service staff",
        "Realty agents",
        "Drivers",
        "IT staff",
        "Cooking staff",
        "Cleaning staff",
        "Low-skill Laborers",
        "Waiters/barmen staff",
    )
}
# The second lender's labels.
MARITAL_GROUPS = {
    "civilmarriage": ("Live-in",),
    "married": ("Married",),
    "separated": ("Annulled", "Divorced", "Separated"),
    "single": ("Single", "Sngl-Paren"),
    "unknown": ("Choose", "N/A", "Unverified"),
    "widow": ("Widow/er",),
}
STATUS_GROUPS = {
    "approved": ("APPROVED", "BOOKED"),
    "rejected": ("DECLINED",),
    "pending": ("IN-PROCESS", "IN-PROCESS-RETURNED-TO-CPS-FROM-RRMD", "PENDING", "RETURNED-CPS", "RETURNED-RRMD"),
    "cancelled": ("CANCELLED",),
}
DECIDED = ("approved", "rejected")
SECOND_LENDER_NAMES = {
    "Gender": "CODE_GENDER",
    "Age": "YEARS_BIRTH",
    "Marital_Status": "NAME_FAMILY_STATUS",
    "Income": "AMT_INCOME_TOTAL",
    "Occupation": "OCCUPATION_TYPE",
    "Loan_Default": "Target",
    "Application_Status": "APPLICATION_STATUS",
}

# Sparse count levels that are merged before dummies are made.
MERGED_LEVELS = {
    "OBS_30_CNT_SOCIAL_CIRCLE": ("10+", [*range(10, 28), 29, 30, 47, 348]),
    "DEF_30_CNT_SOCIAL_CIRCLE": ("4+", [4, 5, 6, 8, 34]),
    "OBS_60_CNT_SOCIAL_CIRCLE": ("10+", [*range(10, 26), 27, 29, 47, 344]),
    "DEF_60_CNT_SOCIAL_CIRCLE": ("4+", [4, 5, 6, 24]),
    "AMT_REQ_CREDIT_BUREAU_DAY": ("4+", [4, 5, 6, 8, 9]),
    "AMT_REQ_CREDIT_BUREAU_WEEK": ("4+", [4, 5, 6, 7, 8]),
    "AMT_REQ_CREDIT_BUREAU_MON": ("10+", [*range(10, 20), 23, 24, 27]),
    "AMT_REQ_CREDIT_BUREAU_QRT": ("4+", [4, 5, 6, 7, 8]),
    "AMT_REQ_CREDIT_BUREAU_YEAR": ("10+", [*range(10, 20), 21, 22, 23, 25]),
    "NAME_FAMILY_STATUS": ("5+", [5, 6]),
}

# Numeric columns that are binned. Housing measures come as _AVG, _MODE and _MEDI.
HOUSING_MEASURES = (
    "APARTMENTS",
    "BASEMENTAREA",
    "YEARS_BEGINEXPLUATATION",
    "YEARS_BUILD",
    "COMMONAREA",
    "ELEVATORS",
    "ENTRANCES",
    "FLOORSMAX",
    "FLOORSMIN",
    "LANDAREA",
    "LIVINGAPARTMENTS",
    "LIVINGAREA",
    "NONLIVINGAPARTMENTS",
    "NONLIVINGAREA",
)
BINNED = (
    "CNT_CHILDREN",
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "REGION_POPULATION_RELATIVE",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "DAYS_REGISTRATION",
    "DAYS_ID_PUBLISH",
    "OWN_CAR_AGE",
    "CNT_FAM_MEMBERS",
    *EXTERNAL_SCORES,
    "DAYS_LAST_PHONE_CHANGE",
    *[f"{m}_{kind}" for kind in ("AVG", "MODE", "MEDI") for m in HOUSING_MEASURES],
    "TOTALAREA_MODE",
)

# The reduced feature set for costly explanations.
EXPLAINED_FEATURES = (
    "CODE_GENDER",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "ANNUITY_LENGTH",
    "EXT_SOURCE_1",
    "CREDIT_TO_GOODS_RATIO",
    "AMT_ANNUITY",
    "NAME_EDUCATION_TYPE",
    "DAYS_BIRTH",
    "DAYS_LAST_DUE_1ST_VERSION_max",
    "NAME_FAMILY_STATUS",
    "CAR_TO_EMPLOY_RATIO",
    "AMT_GOODS_PRICE",
    "DAYS_ID_PUBLISH",
    "ORGANIZATION_TYPE",
    "NAME_CASH_LOAN_PURPOSE_max",
    "CNT_CREDIT_PROLONG_n_distinct",
    "CNT_CREDIT_PROLONG_sum",
    "AMT_INST_MIN_REGULARITY_min",
    "RATE_INTEREST_PRIVILEGED_max",
    "LIVE_REGION_NOT_WORK_REGION",
    "NFLAG_LAST_APPL_IN_DAY_min",
    "STATUS_min_n_distinct",
    "AMT_DRAWINGS_OTHER_CURRENT_sum",
    "AMT_DRAWINGS_OTHER_CURRENT_max",
    "CNT_DRAWINGS_CURRENT_min",
    "CNT_DRAWINGS_OTHER_CURRENT_mean",
    "CNT_DRAWINGS_POS_CURRENT_n_distinct",
    "CREDIT_CURRENCY_sd",
    "NAME_CONTRACT_STATUS_n_distinct_x",
    "NAME_CONTRACT_TYPE_min",
    "NFLAG_INSURED_ON_APPROVAL_min",
    "NFLAG_LAST_APPL_IN_DAY_sd",
    "RATE_INTEREST_PRIVILEGED_min",
)
