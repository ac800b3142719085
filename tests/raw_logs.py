"""Raw transaction logs for tests."""

import csv

RAW_COLUMNS = (
    "index,trans_date_trans_time,cc_num,merchant,category,amt,first,last,gender,street,city,state,"
    "zip,lat,long,city_pop,job,dob,trans_num,unix_time,merch_lat,merch_long,is_fraud"
).split(",")


def raw_row(**values):
    """A raw transaction as CSV would hold it, with some values replaced."""
    base = dict(
        index=1, trans_date_trans_time="2019-01-01 13:05:00", cc_num=100, merchant="m",
        category="home", amt=10.0, first="a", last="b", gender="F", street="s", city="c",
        state="NY", zip="01234", lat=40.0, long=-75.0, city_pop=5, job="Surgeon",
        dob="1985-05-05", trans_num="t1", unix_time=1, merch_lat=40.5, merch_long=-75.5, is_fraud=0)
    assert set(values) <= set(base)
    return {**base, **values}


def write_csv(path, rows, columns=None):
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, columns or RAW_COLUMNS, extrasaction="ignore")
        w.writeheader()
        w.writerows(rows)
    return str(path)
