"""Saving and loading of fitted pipelines; every job has a folder of its own."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save_model(model: PipelineModel, path: str) -> None:
    """Fails when the folder exists, so two jobs cannot share one."""
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
