"""transmuta: corpus migration analytics as Spark DataFrame operators."""

from transmuta.session import recommended_conf, local_session

__all__ = ["recommended_conf", "local_session"]
