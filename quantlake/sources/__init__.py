"""Sources and sinks: the lake's layers, vendor adapters, and the bridge from the driver's tables."""
