"""A vendor for tests: daily bars by code, cut into pages of 100 rows at most."""


def query(api, params):
    if api == "closed":
        from tarnlake.operators.steps import Blocked

        raise Blocked("no permission for closed")
    rows = [{"ts_code": params.get("code", "A"), "trade_date": f"2024-01-{d:02d}", "close": str(d * 10)} for d in range(1, 32)] * 8
    if "offset" not in params:
        return rows[: int(params.get("n", len(rows)))]
    return rows[params["offset"] : params["offset"] + min(100, params["limit"])]


def stuck(api, params):
    return query("bars", params | {"offset": 0})
