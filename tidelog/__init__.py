"""Write-workload analytics over ordered change events, on Spark."""
