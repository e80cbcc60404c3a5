"""Column expressions shared by the operators. Nothing here touches a DataFrame."""
