"""ledgerloom: claims analytics and corpus preparation as PySpark DataFrame plans."""
