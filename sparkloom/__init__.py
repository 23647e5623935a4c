"""sparkloom: revisioned code analytics and review dataflow as Spark DataFrame operators."""
