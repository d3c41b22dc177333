from catalog import sources


def test_all_orders_are_written_and_the_name_alone_chooses(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "_folder", lambda _, name: str(tmp_path / name))
    found = {r.model_class: r.rows for r in sources.forecast_files(spark, sf_dir).collect()}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    written = spark.read.option("header", True).csv(str(tmp_path / "forecasts" / "*_forecasts.csv"))
    assert written.count() == orders.count()
    assert found == {"huber": orders.where("o_custkey % 4 = 0").count(), "mlp": orders.where("o_custkey % 4 = 1").count()}


def test_forecast_files_are_written_anew_by_each_call(spark, sf_dir):
    import __spark_entry__ as contract

    first, second = (sorted(map(tuple, contract.queries()["io8_forecast_files_by_glob"](spark, sf_dir).collect())) for _ in range(2))
    assert first == second
