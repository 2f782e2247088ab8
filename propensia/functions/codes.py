"""Code lists and column names of the bank data set.

They have to equal the published data dictionary for results to be right.
"""

FREQUENCY = {
    "POPLATEK MESICNE": "monthly",
    "POPLATEK TYDNE": "weekly",
    "POPLATEK PO OBRATU": "transactional",
}

LOAN_STATUS = {
    "A": "contract finished",
    "B": "finished contract, loan not paid",
    "C": "running contract",
    "D": "client in debt",
}

ORDER_SYMBOL = {
    "POJISTNE": "insurance_payment",
    "SIPO": "household",
    "UVER": "loan_payment",
    "LEASING": "leasing",
}

TRANS_TYPE = {
    "PRIJEM": "credit",
    "VYDAJ": "withdrawal",
    "VYBER": "withdrawal",
}

TRANS_OPERATION = {
    "VYBER KARTOU": "credit card withdrawal",
    "VKLAD": "credit in cash",
    "PREVOD Z UCTU": "collection from another bank",
    "VYBER": "cash withdrawal",
    "PREVOD NA UCET": "remittance to another bank",
}

TRANS_SYMBOL = {
    "POJISTNE": "insurance payment",
    "SLUZBY": "statement payment",
    "UROK": "interest credited",
    "SANKC. UROK": "sanction interest if negative balance",
    "SIPO": "household payment",
    "DUCHOD": "pension credited",
    "UVER": "loan payment",
}

DISTRICT_COLUMNS = {
    "A1": "district_id",
    "A2": "district_name",
    "A3": "region",
    "A4": "num_of_habitat",
    "A5": "num_of_small_town",
    "A6": "num_of_medium_town",
    "A7": "num_of_big_town",
    "A8": "num_of_bigger_town",
    "A9": "num_of_city",
    "A10": "ratio_of_urban",
    "A11": "average_salary",
    "A12": "unemploy_rate95",
    "A13": "unemploy_rate96",
    "A14": "n_of_enterpren_per1000_inhabit",
    "A15": "no_of_crimes95",
    "A16": "no_of_crimes96",
}

MIN_AGE_DAYS = 6970
HORIZON = 13
FEATURE_PERIODS = 12
RATIO_EPSILON = 1e-7
